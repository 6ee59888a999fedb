"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""
import random

WORDS = ["the", "of", "alpha", "Beta", "gamma,", "delta", "Éclair", "naïve", "zeta!", "eta", "theta", "iota", "x|y", "ß"]


def texts(n=60, seed=3):
    r = random.Random(seed)
    out = [" ".join(r.choice(WORDS) for _ in range(r.choice([0, 1, 2, 5, 40, 60, 120]))) for _ in range(n)]
    out += [out[-1], out[-1] + " tail", None, "", " \t\n ", "one", "\x0bone two three\r\n", out[5] + "\n" + out[5]]
    out.append(" ".join(r.choice(WORDS) for _ in range(5000)))
    return out


def documents(spark, rows=None):
    """doc_id may be null and repeat; extra columns carry names that operators use inside."""
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no id here"), (3, "another text of an old id"), (1, texts()[1])] if rows is None else rows
    return spark.createDataFrame([(i, t, "en", i, "kept") for i, t in rows], "doc_id long, text string, lang string, shard long, key string")
