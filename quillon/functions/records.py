"""Records that arrive as JSON, read leniently: a value of another type than expected counts as missing."""

from __future__ import annotations

import base64
import binascii
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import WS, strip


def text_at(v: Column, path: str) -> Column:
    """The string at a path of a variant; null if there is none or it is no string."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(v, path, "string"))


def _first(v: Column, *paths: str) -> Column:
    filled = [F.when(text_at(v, p) != "", text_at(v, p)) for p in paths]
    return F.coalesce(*filled)


def profile_from(json: Column) -> Column:
    """struct<id, name, email, avatar, provider> of a user's record; null without an id."""
    v, no = F.try_parse_json(json), F.lit("")
    email = F.coalesce(text_at(v, "$.email"), _first(v, "$.user_metadata.email"), no)
    at = F.split_part(email, F.lit("@"), F.lit(1))
    name = F.coalesce(_first(v, "$.user_metadata.full_name", "$.user_metadata.name", "$.user_metadata.user_name", "$.user_metadata.preferred_username"), F.when(at != "", at), F.lit("You"))
    avatar = F.coalesce(_first(v, "$.user_metadata.avatar_url", "$.user_metadata.picture"), no)
    whole = F.struct(text_at(v, "$.id").alias("id"), name.alias("name"), email.alias("email"), avatar.alias("avatar"), F.coalesce(text_at(v, "$.app_metadata.provider"), no).alias("provider"))
    return F.when(text_at(v, "$.id") != "", whole)


def parse_ocr(json: Column) -> Column:
    """struct<content, title, warnings> of a reading service's answer: a fence around the whole content goes; null without content."""
    v = F.try_parse_json(json)
    content = strip(F.coalesce(text_at(v, "$.content"), F.lit("")))
    bare = F.regexp_replace(content, rf"(?is)\A```(?:markdown|md|latex|tex)?{WS}*?\n(.*?)\n```\z", "$1")
    bare = strip(F.replace(bare, F.lit("\r\n"), F.lit("\n")))
    listed = F.coalesce(F.try_variant_get(v, "$.warnings", "array<variant>"), F.array().cast("array<variant>"))
    said = F.transform(F.filter(listed, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: strip(F.try_variant_get(x, "$", "string")))
    warnings = F.slice(F.transform(F.filter(said, lambda x: x != ""), lambda x: F.left(x, F.lit(200))), 1, 8)
    title = F.left(strip(F.coalesce(text_at(v, "$.title"), F.lit(""))), F.lit(80))
    return F.when(content != "", F.struct(bare.alias("content"), title.alias("title"), warnings.alias("warnings")))


def model_answer(json: Column) -> Column:
    """struct<text, error> of a language model's answer; error: blocked, cut off or empty, with the reason given."""
    v = F.try_parse_json(json)
    blocked = text_at(v, "$.promptFeedback.blockReason")
    parts = F.coalesce(F.try_variant_get(v, "$.candidates[0].content.parts", "array<struct<text:string>>"), F.array().cast("array<struct<text:string>>"))
    text = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    reason = text_at(v, "$.candidates[0].finishReason")
    error = (
        F.when(blocked != "", F.concat(F.lit("blocked: "), blocked)).when(reason == "MAX_TOKENS", "cut off")
        .when(text == "", F.concat(F.lit("empty: "), F.coalesce(reason, F.lit("no reason"))))
    )
    return F.struct(F.when(error.isNull(), text).alias("text"), error.alias("error"))


def revive_document(json: Column) -> Column:
    """struct<id, title, text, updated_at, position> of a stored document; null without an id. Times in milliseconds, 0 if unknown."""
    v = F.try_parse_json(json)
    at = F.unix_millis(F.try_to_timestamp(text_at(v, "$.updated_at")))
    position = F.try_variant_get(v, "$.position", "variant")
    number = F.when(~F.schema_of_variant(position).isin("STRING", "BOOLEAN"), F.try_variant_get(v, "$.position", "double"))
    return F.when(
        text_at(v, "$.id").isNotNull(),
        F.struct(
            text_at(v, "$.id").alias("id"), F.coalesce(text_at(v, "$.title"), F.lit("")).alias("title"), text_at(v, "$.text").alias("text"),
            F.coalesce(at, F.lit(0)).alias("updated_at"), F.coalesce(number, F.lit(0.0)).alias("position"),
        ),
    )


#: Longer values are no settings.
LONGEST_SETTING = 65_536


def settings(json: Column, keys: list[str]) -> Column:
    """map<string,string> of the known keys of a settings record that have a string of at most LONGEST_SETTING characters; empty without any."""
    v = F.try_parse_json(json)
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), text_at(v, f"$['{k}']").alias("v")) for k in keys])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull() & (F.length(p["v"]) <= LONGEST_SETTING)))


# What a model's name must have, and what marks one that is not for text.
MODEL, OTHER_MODELS = "gemini", "image|tts|audio|live|embedding|vision|aqa|learnlm"


def ranked_models(json: Column) -> Column:
    """array<struct<id, label>> of the models in a listing that write text: the newest first; of one version flash, lite, others, and each
    before its preview; equals in the listing's order."""
    v = F.try_parse_json(json)
    kind = "array<struct<name:string,displayName:string,supportedGenerationMethods:array<string>>>"
    listed = F.coalesce(F.try_variant_get(v, "$.models", kind), F.array().cast(kind))
    name = lambda m: F.coalesce(m["name"], F.lit(""))
    usable = lambda m: F.coalesce(F.array_contains(m["supportedGenerationMethods"], "generateContent"), F.lit(False)) & name(m).rlike(f"(?i){MODEL}") & ~name(m).rlike(f"(?i){OTHER_MODELS}")

    def keyed(m: Column, i: Column) -> Column:
        n = name(m)
        version = F.coalesce(F.regexp_extract(n, rf"{MODEL}-(\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(0.0))
        tier = F.when(n.contains("flash") & ~n.contains("lite"), 0.0).when(n.contains("flash"), 1.0).otherwise(2.0) + F.when(n.rlike("preview|exp"), 0.5).otherwise(0.0)
        return F.struct((-version).alias("v"), tier.alias("t"), i.alias("i"), F.regexp_replace(n, r"\Amodels/", "").alias("id"), F.coalesce(m["displayName"], n).alias("label"), usable(m).alias("ok"))

    ranked = F.array_sort(F.filter(F.transform(listed, keyed), lambda m: m["ok"]))
    return F.transform(ranked, lambda m: F.struct(m["id"].alias("id"), m["label"].alias("label")))


SHARED = "#s="


def encode_share(text: Column, prefix: str = SHARED) -> Column:
    """A text as a link's fragment: raw deflate in URL-safe base64 without padding."""

    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            if x is None:
                return None
            deflate = zlib.compressobj(wbits=-15)
            return prefix + base64.urlsafe_b64encode(deflate.compress(x.encode("utf-8", "replace")) + deflate.flush()).rstrip(b"=").decode()

        return col.map(one)

    return run(text)


def decode_share(link: Column, prefix: str = SHARED) -> Column:
    """The text of a link's fragment; null if it is none, or cut off or otherwise broken."""

    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            if x is None or not x.startswith(prefix):
                return None
            try:
                body, inflate = x[len(prefix) :], zlib.decompressobj(wbits=-15)
                raw = inflate.decompress(base64.b64decode(body + "=" * (-len(body) % 4), b"-_", validate=True)) + inflate.flush()
                return raw.decode() if inflate.eof else None
            except (binascii.Error, zlib.error, UnicodeDecodeError):
                return None

        return col.map(one)

    return run(link)
