"""Names of journals and conferences in one form: known venues by a key, others word by word.

Distinct names are looked up, not rows: a name is cut into words, words are joined with a table of abbreviations, and what comes out is
joined back to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import WS, ascii_fold, strip

# Abbreviations of the words of titles (ISO 4), and words that are dropped.
WORDS = dict(
    pair.split("=")
    for pair in """transactions=Trans. journal=J. international=Int. conference=Conf. proceedings=Proc. intelligence=Intell. analysis=Anal. machine=Mach.
    learning=Learn. research=Res. review=Rev. reviews=Rev. letters=Lett. physics=Phys. physical=Phys. chemistry=Chem. chemical=Chem. society=Soc. american=Am.
    mathematics=Math. mathematical=Math. science=Sci. sciences=Sci. scientific=Sci. engineering=Eng. computer=Comput. computing=Comput. computational=Comput.
    communications=Commun. systems=Syst. information=Inf. processing=Process. applied=Appl. applications=Appl. statistics=Stat. statistical=Stat. annals=Ann.
    advances=Adv. advanced=Adv. networks=Netw. recognition=Recognit. vision=Vis. graphics=Graph. software=Softw. technology=Technol. electronics=Electron.
    biology=Biol. biological=Biol. medicine=Med. medical=Med. national=Natl. academy=Acad. quarterly=Q. symposium=Symp. annual=Annu. theoretical=Theor.
    robotics=Robot. automation=Autom. language=Lang. languages=Lang. linguistics=Linguist. association=Assoc. optimization=Optim. numerical=Numer.
    industrial=Ind. european=Eur. royal=R. series=Ser. acoustics=Acoust. knowledge=Knowl. discovery=Discov. management=Manag. artificial=Artif.
    foundations=Found. geometry=Geom. environmental=Environ. materials=Mater. biomedical=Biomed. molecular=Mol. nuclear=Nucl. optics=Opt. psychology=Psychol.
    economics=Econ. economic=Econ. operations=Oper. bulletin=Bull. experimental=Exp. mechanics=Mech. astronomy=Astron. neuroscience=Neurosci.
    cognitive=Cogn. programming=Program. distributed=Distrib. security=Secur. multimedia=Multimed. visualization=Vis. interaction=Interact. human=Hum.
    sensing=Sens. wireless=Wirel. representations=Represent. empirical=Empir. natural=Nat. uncertainty=Uncertain. methods=Methods theory=Theory
    workshop=Worksh.""".split()
)
DROPPED = ("of", "the", "on", "and", "for", "in", "&", "\\&")
KEY_DROPPED = "proceedings proc of the in on and for volume vol part".split()
# Known venues as "full name | other names; ... | short name". Where there is no short name, it is the words abbreviated, and for
# a conference (its first other name in brackets) that acronym after them.
VENUES = """
IEEE Transactions on Pattern Analysis and Machine Intelligence | TPAMI; IEEE TPAMI; PAMI
IEEE Transactions on Image Processing | TIP; IEEE TIP
IEEE Transactions on Neural Networks and Learning Systems | TNNLS | IEEE Trans. Neural Netw. Learn. Syst.
IEEE Transactions on Information Theory
IEEE Transactions on Signal Processing | | IEEE Trans. Signal Process.
International Journal of Computer Vision | IJCV
Journal of Machine Learning Research | JMLR; The Journal of Machine Learning Research
Transactions on Machine Learning Research | TMLR
Machine Learning
Artificial Intelligence
Journal of Artificial Intelligence Research | JAIR
Neural Computation | | Neural Comput.
Neural Networks
Nature Machine Intelligence | | Nat. Mach. Intell.
ACM Computing Surveys | | ACM Comput. Surv.
ACM Transactions on Graphics | TOG
Communications of the ACM | CACM
Journal of the ACM | JACM
Advances in Neural Information Processing Systems | NeurIPS; NIPS; Neural Information Processing Systems; Conference on Neural Information Processing Systems; Adv. Neural Inf. Process. Syst. | Adv. Neural Inf. Process. Syst. (NeurIPS)
Proceedings of the International Conference on Machine Learning | [ICML]; International Conference on Machine Learning
International Conference on Learning Representations | [ICLR]
Proceedings of the IEEE/CVF Conference on Computer Vision and Pattern Recognition | [CVPR]; IEEE Conference on Computer Vision and Pattern Recognition; Computer Vision and Pattern Recognition; IEEE Computer Society Conference on Computer Vision and Pattern Recognition; Proc. IEEE Conf. Comput. Vis. Pattern Recognit.
Proceedings of the IEEE/CVF International Conference on Computer Vision | [ICCV]; IEEE International Conference on Computer Vision; International Conference on Computer Vision
Proceedings of the European Conference on Computer Vision | [ECCV]; European Conference on Computer Vision
Proceedings of the AAAI Conference on Artificial Intelligence | [AAAI]; AAAI Conference on Artificial Intelligence
Proceedings of the International Joint Conference on Artificial Intelligence | [IJCAI]; International Joint Conference on Artificial Intelligence
Proceedings of the Annual Meeting of the Association for Computational Linguistics | ACL; Association for Computational Linguistics; Annual Meeting of the Association for Computational Linguistics | Proc. Annu. Meet. Assoc. Comput. Linguist. (ACL)
Proceedings of the Conference on Empirical Methods in Natural Language Processing | EMNLP; Empirical Methods in Natural Language Processing | Proc. Conf. Empir. Methods Nat. Lang. Process. (EMNLP)
Proceedings of the Conference of the North American Chapter of the Association for Computational Linguistics | NAACL; NAACL-HLT; North American Chapter of the Association for Computational Linguistics | Proc. Conf. North Am. Chapter Assoc. Comput. Linguist. (NAACL)
Proceedings of the ACM SIGKDD International Conference on Knowledge Discovery and Data Mining | KDD; SIGKDD | Proc. ACM SIGKDD Int. Conf. Knowl. Discov. Data Min. (KDD)
Proceedings of the International Conference on Artificial Intelligence and Statistics | [AISTATS]
Proceedings of the Conference on Uncertainty in Artificial Intelligence | [UAI]
Proceedings of the Conference on Learning Theory | [COLT]
Proceedings of the IEEE International Conference on Robotics and Automation | [ICRA]
Proceedings of the IEEE International Conference on Acoustics, Speech and Signal Processing | ICASSP | Proc. IEEE Int. Conf. Acoust. Speech Signal Process. (ICASSP)
Nature
Science
Nature Communications | | Nat. Commun.
Proceedings of the National Academy of Sciences | PNAS; Proceedings of the National Academy of Sciences of the United States of America; Proc. Natl. Acad. Sci. | Proc. Natl. Acad. Sci. U.S.A.
Physical Review Letters | PRL
Physical Review A
Physical Review B
Physical Review D
Physical Review E
Reviews of Modern Physics | | Rev. Mod. Phys.
Journal of the American Chemical Society | JACS
Angewandte Chemie International Edition | | Angew. Chem. Int. Ed.
Annals of Mathematics
SIAM Journal on Computing
SIAM Journal on Numerical Analysis
SIAM Journal on Optimization
SIAM Journal on Scientific Computing
SIAM Review
Annals of Statistics | The Annals of Statistics
Journal of the American Statistical Association | JASA
Journal of the Royal Statistical Society: Series B | Journal of the Royal Statistical Society Series B (Statistical Methodology) | J. R. Stat. Soc. Ser. B
Cell
The New England Journal of Medicine | NEJM | N. Engl. J. Med.
"""


def venue_key(name: Column) -> Column:
    """What tells venues apart: words of letters without those that all have, years, ordinals and what is in parentheses."""
    c = F.regexp_replace(F.regexp_replace(name, r"\\?&", " and "), r"\([^)]*\)", " ")
    c = F.lower(ascii_fold(c))
    c = F.regexp_replace(F.regexp_replace(c, r"'\d\d\b", " "), r"\b\d+(?:st|nd|rd|th)\b", " ")
    return F.array_join(F.filter(F.split(c, "[^a-z]+"), lambda w: (w != "") & ~w.isin(*KEY_DROPPED)), " ")


def word_table(spark: SparkSession) -> DataFrame:
    """(word, short): as large as the program text, so it may be broadcast."""
    return F.broadcast(spark.createDataFrame(list(WORDS.items()), "word string, short string"))


def abbreviated_words(names: DataFrame, name: str) -> DataFrame:
    """Distinct values of `name` with `iso4`: words abbreviated, articles and conjunctions but the first word dropped; one word stays."""
    distinct = names.select(name).where(F.col(name).isNotNull()).distinct()
    shape = r"\A([^A-Za-z]*)([A-Za-z]+)([^A-Za-z]*)\z"
    words = distinct.select(name, F.posexplode(F.split(strip(F.col(name)), rf"{WS}+")).alias("i", "w")).withColumn("word", F.lower(F.regexp_extract("w", shape, 2)))
    short = F.concat(F.regexp_extract("w", shape, 1), F.col("short"), F.regexp_replace(F.regexp_extract("w", shape, 3), r"\A\.", ""))
    dropped = (F.col("i") > 0) & F.lower("w").isin(*DROPPED)
    joined = words.join(word_table(names.sparkSession), "word", "left")
    kept = F.array_sort(F.collect_list(F.when(~dropped, F.struct("i", F.coalesce(short, F.col("w")).alias("t")))))
    one = joined.groupBy(name).agg(F.array_join(F.transform(kept, lambda x: x["t"]), " ").alias("_short"), F.count("*").alias("_n"))
    return one.select(name, F.when(F.col("_n") < 2, strip(F.col(name))).otherwise(F.col("_short")).alias("iso4"))


def venue_table(spark: SparkSession) -> DataFrame:
    """(key, full, short) of the known venues by each of their names; of a key that two have, the later one."""
    rows = []
    for i, line in enumerate(x for x in VENUES.splitlines() if x.strip()):
        full, others, short = [*(p.strip() for p in line.split("|")), "", ""][:3]
        others = [o.strip() for o in others.split(";") if o.strip()]
        acronym = next((o[1:-1] for o in others if o.startswith("[")), "")
        rows.append((i, full, short, acronym, [full, *(o.strip("[]") for o in others), *([short] if short else [])]))
    given = spark.createDataFrame(rows, "i int, full string, given string, acronym string, names array<string>")
    made = given.join(abbreviated_words(given, "full"), "full")
    made = made.withColumn("short", F.when(F.col("given") != "", F.col("given")).when(F.col("acronym") != "", F.concat("iso4", F.lit(" ("), "acronym", F.lit(")"))).otherwise(F.col("iso4")))
    keys = made.select("i", "full", "short", F.explode(F.array_append("names", F.col("short"))).alias("name")).select("i", "full", "short", venue_key(F.col("name")).alias("key"))
    return F.broadcast(keys.groupBy("key").agg(F.max_by("full", "i").alias("full"), F.max_by("short", "i").alias("short")))


def with_venue(rows: DataFrame, name: str, mode: str = "abbrev") -> DataFrame:
    """rows with `venue`: the name as it is (mode "keep"), in full, or abbreviated. Unknown venues stay as they are in full, and are abbreviated
    word by word. A null name stays null."""
    if mode == "keep":
        return rows.withColumn("venue", F.col(name))
    known = abbreviated_words(rows, name).withColumn("key", venue_key(F.col(name))).join(venue_table(rows.sparkSession), "key", "left")
    shown = F.coalesce("full", name) if mode == "full" else F.coalesce("short", "iso4")
    return rows.join(known.select(F.col(name).alias("_name"), shown.alias("venue")), F.col(name) == F.col("_name"), "left").drop("_name")
