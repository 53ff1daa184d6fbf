"""Fields, bookmarks and internal links of a document, and what an edit lost of them.

A complex field is a bracket (begin, instruction, separate, result, end) that nests; the
brackets are matched by scans over the marks of a part, not by a stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import scan
from . import document_rules as D

# Fields whose first argument names a bookmark.
REFERRING = ["REF", "PAGEREF", "NOTEREF"]
#: Names that a message spells out.
LISTED = 5
KEY = ["doc", "part"]


def folded(name: Column) -> Column:
    """Bookmark names compare without case; a sharp s and the like by their long form."""
    return F.lower(F.upper(name))


def fields(nodes: DataFrame) -> DataFrame:
    """(doc, part, id, kind, instruction, derived) of every field of nodes that names a kind.

    An instruction is what a field reads before its separator, inner fields' texts aside;
    one that never ends counts too. derived: it lies in the result of another field.
    """
    tag, attr = F.col("tag"), F.col("attrs")
    rows = nodes.where("not alt_branch").where(tag.isin("w:fldSimple", "w:fldChar", "w:instrText", "w:delInstrText"))
    state = F.when(tag == "w:fldSimple", "simple").when(tag == "w:fldChar", attr["w:fldCharType"]).otherwise("text")
    said = F.when(tag == "w:fldSimple", F.coalesce(attr["w:instr"], F.lit(""))).otherwise(F.coalesce("text", F.lit("")))
    inner = F.array_contains("anc_tags", "w:fldSimple")
    rows = rows.select(*KEY, "id", state.alias("state"), said.alias("said"), inner.alias("inner"))
    told = scan.brackets(rows, KEY, [F.col("id")], F.col("state"))
    spans = told.where("owner is not null").groupBy(*KEY, "owner").agg(
        F.min(F.when(F.col("state") == "separate", F.col("n"))).alias("sep"), F.min(F.when(F.col("state") == "end", F.col("n"))).alias("close")
    )
    told = told.join(spans, [*KEY, "owner"], "left")
    reading = told.where("state = 'text' and owner is not null and (sep is null or n < sep)")
    texts = reading.groupBy(*KEY, F.col("owner").alias("n")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "said"))), lambda x: x["said"]), "").alias("read"))
    # results that are open at a field's begin: from a first separator to the end of its bracket
    change = F.when(F.col("n") == F.col("sep"), 1).when((F.col("n") == F.col("close")) & F.col("sep").isNotNull(), -1).otherwise(0)
    told = scan.running_total(told, KEY, [F.col("n")], change, "results")
    heads = told.where("state in ('simple', 'begin')").join(texts, [*KEY, "n"], "left")
    text = T.squeezed(F.when(F.col("state") == "simple", F.col("said")).otherwise(F.coalesce("read", F.lit(""))))
    heads = heads.select(*KEY, "id", text.alias("t"), ((F.col("results") > 0) | F.col("inner")).alias("derived"))
    formula = F.col("t").startswith("=")
    kind = F.when(formula, "=").otherwise(F.upper(F.substring_index("t", " ", 1)))
    rest = F.regexp_replace("t", "^[^ ]*", "")
    return heads.where("t <> ''").select(*KEY, "id", kind.alias("kind"), F.when(formula, F.col("t")).otherwise(F.concat(kind, rest)).alias("instruction"), "derived")


def target(kind: Column, instruction: Column) -> Column:
    """The bookmark that a field names: a reference's first argument, or that of a local link."""

    def argument(pattern: str) -> Column:
        quoted = F.regexp_extract(rest, pattern, 1)
        bare = F.regexp_extract(rest, pattern, 2)
        return F.when(rest.rlike(pattern), F.when(bare != "", bare).otherwise(quoted))

    rest = F.regexp_extract(instruction, r"^[^ ]* (.*)$", 1)
    first = argument(r'(?U)"([^"]*)"|(\S+)')
    return F.when(kind.isin(*REFERRING), F.when(~first.startswith("\\"), first)).when(kind == "HYPERLINK", argument(r'(?U)\\l\s+(?:"([^"]*)"|(\S+))'))


def bookmarks(nodes: DataFrame, stories: DataFrame) -> DataFrame:
    """(doc, key, name) of the bookmarks of a document's stories, by their folded names."""
    named = nodes.where("tag = 'w:bookmarkStart' and not alt_branch").select(*KEY, "id", F.col("attrs")["w:name"].alias("name")).where("name <> ''")
    named = named.join(stories.select(*KEY).distinct(), KEY)
    return named.groupBy("doc", folded(F.col("name")).alias("key")).agg(F.min_by("name", F.struct("part", "id")).alias("name"))


def uses(nodes: DataFrame, stories: DataFrame) -> DataFrame:
    """(doc, story, kind, key, written, derived, links) of every field in each story that shows
    it, and of every link element (kind 'link'). key: the folded name of the bookmark it
    points at, or null."""
    found = fields(nodes).withColumn("written", target(F.col("kind"), F.col("instruction")))
    links = nodes.where("tag = 'w:hyperlink' and not alt_branch").select(*KEY, F.lit("link").alias("kind"), F.col("attrs")["w:anchor"].alias("written"), F.lit(False).alias("derived"))
    both = found.select(*KEY, "kind", "written", "derived").unionByName(links)
    key = F.when(F.col("written") != "", folded(F.col("written")))
    return both.join(stories, KEY).select("doc", "story", "kind", key.alias("key"), "written", "derived")


def sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the sources and of the edits of pairs; doc is the pair then."""
    pair = F.substring("doc", 3, 1 << 30)
    return tuple(df.where(F.col("doc").startswith(side)).withColumn("doc", pair) for side in ("s:", "e:"))


def listed(names: Column) -> Column:
    return V.names_and_more(F.transform(names, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), LISTED)


def lost_bookmarks(marks: DataFrame, used: DataFrame) -> DataFrame:
    """FID015: bookmarks of the source that are gone, by what in the edit still points at them;
    hidden ones only if something does."""
    before, after = sides(marks)
    gone = before.join(after.select("doc", "key"), ["doc", "key"], "left_anti")
    _, now = sides(used.where("key is not null"))
    refers = F.col("kind").isin(*REFERRING)
    pointing = now.groupBy("doc", "key").agg(F.count_if(refers).alias("by_fields"), F.count_if(~refers).alias("by_links"))
    gone = gone.join(pointing, ["doc", "key"], "left").na.fill(0, ["by_fields", "by_links"])
    group = F.when(F.col("by_fields") > 0, "fields").when(F.col("by_links") > 0, "links").when(~F.col("name").startswith("_"), "nothing")
    gone = gone.withColumn("by", group).where("by is not null")
    points = F.when(F.col("by") == "fields", F.col("by_fields")).otherwise(F.col("by_links"))
    per = gone.groupBy("doc", "by").agg(F.count("*").alias("lost"), F.sum(points).alias("points"), F.sort_array(F.collect_list("name")).alias("names"))
    text = F.concat(
        "lost", F.lit(" bookmark(s) of the source are missing ("), listed(F.col("names")), F.lit(")"),
        F.when(F.col("by") == "fields", F.concat(F.lit("; "), "points", F.lit(" field(s) refer to them and will show an error once updated")))
        .when(F.col("by") == "links", F.concat(F.lit("; "), "points", F.lit(" internal link(s) lead nowhere now"))).otherwise("; only other documents could refer to them"),
    )
    return D.found(per, "FID015", F.when(F.col("by") == "fields", "error").otherwise("warn"), text, F.col("by"))


def lost_fields(used: DataFrame) -> DataFrame:
    """FID016: by story and kind, fields that are gone or point elsewhere. References count by
    bookmark, others by number; a hyperlink field may have become a link element."""
    own = used.where("not derived and kind <> 'link'")
    key = F.when(F.col("kind").isin(*REFERRING), F.coalesce("key", F.lit(""))).otherwise("")
    counts = own.groupBy("doc", "story", "kind", key.alias("aim")).agg(F.count("*").alias("n"), F.min("written").alias("written"))
    before, after = sides(counts)
    by = ["doc", "story", "kind", "aim"]
    missing = F.greatest(F.lit(0), F.col("n") - F.coalesce("m", F.lit(0)))
    both = before.join(after.select(*by, F.col("n").alias("m")), by, "left").withColumn("missing", missing)
    aims = F.array_sort(F.flatten(F.collect_list(F.when((F.col("aim") != "") & (F.col("missing") > 0), F.array_repeat("written", F.col("missing").cast("int"))))))
    per = both.groupBy("doc", "story", "kind").agg(F.sum("n").alias("had"), F.sum("missing").alias("lost"), aims.alias("aims"))
    per = per.join(after.groupBy("doc", "story", "kind").agg(F.sum("n").alias("has")), ["doc", "story", "kind"], "left").na.fill(0, ["has"])
    was, now = sides(used.where("kind = 'link'").groupBy("doc", "story").agg(F.count("*").alias("links")))
    per = per.join(was.withColumnRenamed("links", "was"), ["doc", "story"], "left").join(now.withColumnRenamed("links", "now"), ["doc", "story"], "left").na.fill(0, ["was", "now"])
    became = F.when(F.col("kind") == "HYPERLINK", F.greatest(F.lit(0), F.col("now") - F.col("was"))).otherwise(0)
    per = per.withColumn("lost", F.col("lost") - became).where("lost > 0")
    refers = F.col("kind").isin(*REFERRING)
    amount = F.when(F.col("has") == 0, F.concat(F.lit("all "), "had")).otherwise(F.concat("lost", F.lit(" of "), "had"))
    text = F.concat(
        "story", F.lit(": "), amount, F.lit(" "), "kind", F.lit(" field(s) of the source are gone"),
        F.when((F.col("has") > 0) & (F.size("aims") > 0), F.lit(" or refer to something else")).otherwise(""),
        F.when(F.size("aims") > 0, F.concat(F.lit(" (they named "), listed(F.col("aims")), F.lit(")"))).otherwise(""),
        F.lit("; what they showed is plain text now, if it is there"),
    )
    return D.found(per, "FID016", F.when((F.col("has") == 0) | refers, "error").otherwise("warn"), text, F.col("kind"), where=F.col("story"))


def reference_losses(nodes: DataFrame, stories: DataFrame) -> list[DataFrame]:
    used = scan.cut(uses(nodes, stories))
    return [lost_bookmarks(bookmarks(nodes, stories), used), lost_fields(used)]
