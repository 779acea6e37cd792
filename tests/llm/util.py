import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu", "pe", "ra", "so", "ti") for b in ("bel", "dor", "fin", "gam", "hul", "jen", "kor", "lam") for c in ("a", "e", "in", "os", "ur", "ix")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs(spark, rows, extra=()):
    """Rows of documents from (doc_id, text); with ``extra`` columns, all holding 1."""
    full = [(i, t, "en", "src0", None if t is None else len(t), *(1 for _ in extra)) for i, t in rows]
    return spark.createDataFrame(full, DOCS + "".join(f", `{c}` int" for c in extra))


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def words(t):
    return re.findall(r"\w+", t.lower())
