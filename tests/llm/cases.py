"""Documents with every awkward case, and plain Python versions of words."""

import random
import re

from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType()), StructField("id", LongType()), StructField("score", StringType())])


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def texts(seed=1):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base, passage = prose(90), prose(60)
    out = [None, "", " \n\t ", "one", "two words", "one", base, base, base.upper(), base + " " + prose(4), " ".join(base.split()[3:]), prose(30) + "\n" + passage + "\n" + prose(25), passage + " " + prose(40)]
    out += [prose(20) + " " + passage, "\n".join([prose(9)] * 12), "é" * 50 + " ñandú 北京 " + prose(20), prose(3000), "a b " * 40, "x" * 5000, base + "\n\n" + base, prose(13), prose(12), "\r\n".join(["same line here"] * 3 + ["other"])]
    out += [prose(r.randint(1, 80)) for _ in range(25)]
    return out


def frame(spark, rows=None):
    rows = rows if rows is not None else list(enumerate(texts()))
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if (i or 0) % 5 else None, len(t or ""), 7, "x") for i, t in rows], SCHEMA)
