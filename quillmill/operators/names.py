"""New names of the same shape for words: distinct, and none of them a word of the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan
from .tables import cut, drop

# The characters of each class; a class of a shape is its letter here.
ALPHABETS = {"d": "0123456789", "U": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "l": "abcdefghijklmnopqrstuvwxyz"}
#: Characters by which names differ, from the first on; the others are filled in.
FRONT = 10
#: Words so short may have a name that the text knows: their alphabets are used up soon.
SHORT = 4
BLOCK = 10_000
NUMBER = "decimal(38,0)"


def shape(word: Column) -> Column:
    """Each character's class: digit, capital, or anything else."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(word, r"[^\p{Nd}\p{Lu}]", "l"), r"\p{Lu}", "U"), r"\p{Nd}", "d")


def _classes(shape_: Column) -> Column:
    return F.filter(F.split(shape_, ""), lambda c: c != "")


def _base(c: Column) -> Column:
    return F.when(c == "d", 10).otherwise(26)


def capacity(shape_: Column) -> Column:
    """How many names a shape has, by its first characters."""
    return F.aggregate(_classes(F.substring(shape_, 1, FRONT)), F.lit(1).cast("long"), lambda n, c: n * _base(c))


def spelled(number: Column, shape_: Column) -> Column:
    """The name of a number: the last of the first characters counts least."""
    start = F.struct(number.cast("long").alias("n"), F.lit("").alias("s"))

    def step(a: Column, c: Column) -> Column:
        at = (a["n"] % _base(c)).cast("int") + 1
        letter = F.when(c == "d", F.substring(F.lit(ALPHABETS["d"]), at, F.lit(1))).when(c == "U", F.substring(F.lit(ALPHABETS["U"]), at, F.lit(1))).otherwise(F.substring(F.lit(ALPHABETS["l"]), at, F.lit(1)))
        return F.struct(F.floor(a["n"] / _base(c)).cast("long").alias("n"), F.concat(letter, a["s"]).alias("s"))

    return F.aggregate(F.reverse(_classes(F.substring(shape_, 1, FRONT))), start, step)["s"]


def _filled(word: Column, shape_: Column, secret: str) -> Column:
    """Characters for the places after the first ones, drawn from a digest of the word."""
    digest = F.sha2(F.concat(F.lit(secret), word).cast("binary"), 256)

    def letter(c: Column, i: Column) -> Column:
        value = F.conv(F.substring(digest, ((i * 2) % 64 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
        at = value % _base(c) + 1
        return F.when(c == "d", F.substring(F.lit(ALPHABETS["d"]), at, F.lit(1))).when(c == "U", F.substring(F.lit(ALPHABETS["U"]), at, F.lit(1))).otherwise(F.substring(F.lit(ALPHABETS["l"]), at, F.lit(1)))

    rest = _classes(F.substring(shape_, FRONT + 1, 1 << 30))
    return F.array_join(F.transform(rest, letter), "")


def attempts(per: DataFrame) -> DataFrame:
    """(shape, j, front): the first `tried` names of each shape of per(shape, size, factor,
    shift, tried). A shape with many names is many tasks: blocks are few bytes, so their
    partitions must not be put together."""
    many = int(per.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = per.select("shape", "size", "factor", "shift", "tried", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tried") - 1) / BLOCK))).alias("block")).repartition(many, "shape", "block")
    low = F.col("block") * BLOCK
    tried = blocks.select("shape", "size", "factor", "shift", F.explode(F.sequence(low, F.least(low + BLOCK, F.col("tried")) - 1)).alias("j"))
    value = (F.col("factor").cast("decimal(18,0)") * F.col("j").cast("decimal(18,0)") + F.col("shift").cast("decimal(18,0)")) % F.col("size").cast("decimal(18,0)")
    return tried.select("shape", "j", spelled(value, F.col("shape")).alias("front"))


def renamed(words: DataFrame, secret: str) -> DataFrame:
    """(word, name, collides) of the distinct words(word) that aren't empty, written.

    A name has its word's length and character classes. No two words share one, and none of
    SHORT characters or more is a word of the table, unless a shape has more words than
    names (collides then). The k-th word of a shape, in the order of a keyed digest, takes
    the k-th name that a keyed permutation of all names of the shape gives and that no
    word has; nothing is drawn, so a task that runs again gives the same.
    """
    own = cut(words.where("word <> ''").select("word").distinct().withColumn("shape", shape(F.col("word"))))
    plain = F.col("word").rlike("^[0-9A-Za-z]*$") & (F.length("word") >= SHORT)
    per = own.groupBy("shape").agg(F.count("*").alias("n"), F.count_if(plain).alias("taken"))
    key = F.sha2(F.concat(F.lit(secret + ":"), "shape").cast("binary"), 256)
    part = lambda at: F.conv(F.substring(key, at, 15), 16, 10).cast("long")
    per = per.withColumn("size", capacity(F.col("shape")))
    # the sizes have no prime factor but 2, 5 and 13, so a factor of 1 modulo 130 permutes
    per = per.withColumns({
        "factor": 1 + 130 * (part(1) % F.greatest(F.floor(F.col("size") / 130).cast("long"), F.lit(1))), "shift": part(16) % F.col("size"),
        "tried": F.least(F.col("size"), F.col("n") + F.col("taken")),
    })
    tried = cut(attempts(per))
    known = own.where(plain).select("shape", F.substring("word", 1, FRONT).alias("front")).distinct()
    free = scan.numbered(tried.join(known, ["shape", "front"], "left_anti"), ["shape"], [F.col("j")], "k")
    many = free.groupBy("shape").agg(F.count("*").alias("m"))
    order = F.sha2(F.concat(F.lit(secret), "word").cast("binary"), 256)
    mine = scan.numbered(own.withColumn("o", order), ["shape"], [F.col("o")], "nth").join(many, "shape", "left")
    again = F.coalesce(F.col("nth") > F.col("m"), F.lit(True))
    mine = mine.withColumns({"collides": again, "k": F.when(F.col("m") > 0, (F.col("nth") - 1) % F.col("m") + 1)})
    out = mine.join(free.select("shape", "k", "front"), ["shape", "k"], "left")
    # where every name is a word's, the word's own digest spells one
    front = F.coalesce("front", spelled(F.conv(F.substring(F.col("o"), 1, 13), 16, 10).cast("long") % capacity(F.col("shape")), F.col("shape")))
    out = cut(out.select("word", F.concat(front, _filled(F.col("word"), F.col("shape"), secret)).alias("name"), "collides"))
    drop(own, tried)
    return out
