"""What an edit did to tracked changes: their texts, their growth, notes that lost them, and
replacements wider than the change. Metadata (kind, author, date) is a context, not an
identity; what can't be read for certain is left out of a comparison.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import budget
from . import document_rules as D
from .reading import CHARACTERS, INSERTED, REVISIONS, joined, owner, pieces, under
from .references import sides

# Inline revisions and the element that holds their text.
INLINE = {"w:ins": "w:t", "w:del": "w:delText"}
NAMES = {"w:ins": "insertion", "w:del": "deletion"}
# Fixed value: characters that searches for texts with other bounds may read in a document.
SCAN_BUDGET = 64 * 1024 * 1024
# Attributes of an inline revision, and elements in it that show nothing.
ATTRIBUTES = ["w:id", "w:author", "w:date", "w16du:dateUtc"]
MARKERS = ["w:proofErr", "w:bookmarkStart", "w:bookmarkEnd", "w:commentRangeStart", "w:commentRangeEnd", "w:permStart", "w:permEnd"]
# Fixed value: unchanged words that a replacement may carry.
UNCHANGED_WORDS = 4

def attr(name: str) -> Column:
    return F.col("attrs")[name]


def leaf() -> Column:
    """An element without child elements."""
    return F.col("last") == F.col("id")


def named(table: dict[str, str], tag: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[tag]


def date() -> Column:
    return F.coalesce(attr("w16du:dateUtc"), attr("w:date"))


def ancestor(level: Column, names: str) -> Column:
    """Of the ancestors (1 is the parent) the one at a level; null below 1."""
    return F.when(level >= 1, F.get(names, level - 1))


def in_order(value: str) -> Column:
    """The texts of a group in reading order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", F.col(value).alias("v")))), lambda x: x["v"]), "")


# texts of inline revisions


def payloads(body: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the body's inline revisions: (doc, alt, kind, n, supported) and (doc, alt, kind, id,
    text) of each. A kind is supported if all of its revisions stand in paragraphs and hold
    runs of plain text only, none empty."""
    rows = body.withColumn("alt", F.col("alt_branch"))
    own = rows.where(F.col("tag").isin(*INLINE)).select("doc", "alt", F.col("tag").alias("kind"), "id", F.get("anc_tags", F.lit(0)).eqNullSafe("w:p").alias("direct"))
    places = [F.nullif(F.array_position("anc_tags", k), F.lit(0)) for k in INLINE]
    depth = F.least(*places).cast("int")  # least() passes nulls over
    inside = rows.withColumn("depth", depth).where("depth is not null").withColumns({"kind": F.get("anc_tags", depth - 1), "rev": F.get("anc_ids", depth - 1)})
    is_text = (F.col("depth") == 2) & (F.col("tag") == named(INLINE, F.col("kind")))
    good = (
        F.when(F.col("depth") == 1, F.col("tag") == "w:r")
        .when(F.col("depth") == 2, (F.get("anc_tags", F.lit(0)) == "w:r") & ((F.col("tag") == "w:rPr") | (is_text & leaf())))
        .otherwise(ancestor(F.col("depth") - 2, "anc_tags") == "w:rPr")
    )
    inside = inside.withColumns({"good": F.coalesce(good, F.lit(False)), "said": F.when(is_text, F.coalesce("text", F.lit("")))})
    told = inside.groupBy("doc", "alt", "rev").agg(F.bool_and("good").alias("plain"), in_order("said").alias("text"))
    each = own.join(told.withColumnRenamed("rev", "id"), ["doc", "alt", "id"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    fine = F.col("direct") & F.coalesce("plain", F.lit(False)) & (F.col("text") != "")
    kinds = each.groupBy("doc", "alt", "kind").agg(F.count("*").alias("n"), F.bool_and(fine).alias("supported"))
    return kinds, each.select("doc", "alt", "kind", "id", "text")


def payload_losses(body: DataFrame, limit: int = SCAN_BUDGET) -> tuple[DataFrame, DataFrame]:
    """FID009: texts of the source's revisions that the edit has less often, where each kind has
    as many revisions as before. A text that is no revision's own any more is looked for in
    the kind's whole text; such searches have a budget, spent in the order of view, kind and
    place. Two tables: of the usual view and of the later branches."""
    kinds, each = payloads(body)
    k1, k2 = sides(kinds.where("supported"))
    both = k1.join(k2.select("doc", "alt", "kind", "n"), ["doc", "alt", "kind", "n"]).select("doc", "alt", "kind")
    r1, r2 = sides(each)
    by = ["doc", "alt", "kind"]
    before = r1.join(both, by, "left_semi").groupBy(*by, "text").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    now = r2.join(both, by, "left_semi")
    have = now.groupBy(*by, "text").agg(F.count("*").alias("m"))
    short = before.join(have, [*by, "text"], "left").na.fill(0, ["m"]).where("m < n")
    streams = now.groupBy(*by).agg(in_order("text").alias("stream"))
    priced = short.join(streams.select(*by, F.length("stream").alias("cost")), by).withColumn("at", F.when(F.col("kind") == "w:ins", 0).otherwise(1))
    asked = budget.within_budget(priced, ["doc"], ["alt", "at", "first", "text"], "cost", limit).where("taken")
    found = asked.join(streams, by).withColumn("m", T.occurrences(F.col("stream"), F.col("text"))).where("m < n")
    said = F.concat(
        F.lit("text of a tracked "), named(NAMES, F.col("kind")), F.lit(" of the source is missing or changed, "), F.col("n") - F.col("m"), F.lit(" of "), "n",
        F.lit(", though there are as many as before: "), T.snippet(F.col("text"), 80),
    )
    alike = lambda rows: D.found(rows, "FID009", "error", said, F.col("text"), part="word/document.xml")
    return alike(found.where("not alt")), alike(found.where("alt"))


# joined and split revisions


def signatures(body: DataFrame) -> DataFrame:
    """(doc, alt, tag, digest) of the inline revisions of a tag: the whole texts of the
    paragraphs they stand in, with each stretch's context and run properties, however it is
    cut into wrappers and runs. No row where anything else is in such a paragraph."""
    rows = body.withColumn("alt", F.col("alt_branch"))
    ordinal = F.row_number().over(Window.partitionBy("doc", "alt").orderBy("id"))  # of one document
    paragraphs = rows.where("tag = 'w:p'").select("doc", "alt", F.col("id").alias("p"), ordinal.alias("ordinal"))
    revs = rows.where(F.col("tag").isin(*INLINE))
    odd = revs.where(~F.get("anc_tags", F.lit(0)).eqNullSafe("w:p")).select("doc", "alt", "tag").distinct()
    used = revs.select("doc", "alt", "tag", F.col("parent").alias("p")).distinct().join(paragraphs, ["doc", "alt", "p"])
    inside = rows.withColumn("p", owner("w:p")).join(used.select("doc", "alt", "p").distinct(), ["doc", "alt", "p"])
    inside = inside.withColumn("up", F.array_position("anc_tags", "w:p").cast("int"))  # 1: a child of the paragraph
    top = F.when(F.col("up") == 1, F.col("tag")).otherwise(ancestor(F.col("up") - 1, "anc_tags"))
    inside = inside.withColumn("top", top).where("top <> 'w:pPr'")
    wrapped = F.col("top").isin(*INLINE)
    run_up = F.col("up") - F.when(wrapped, 2).otherwise(1)  # 0: a run; 1: a child of one
    inside = inside.withColumns({
        "run_up": run_up, "run": F.when(run_up == 0, F.col("id")).otherwise(ancestor(run_up, "anc_ids")),
        "wrapper": F.when(wrapped, F.when(F.col("up") == 1, F.col("id")).otherwise(ancestor(F.col("up") - 1, "anc_ids"))),
    })
    expected = F.when(F.col("top") == "w:del", "w:delText").otherwise("w:t")
    only = lambda names: F.size(F.array_except(F.map_keys("attrs"), F.array(*map(F.lit, names)))) == 0
    is_text, in_props = (F.col("run_up") == 1) & (F.col("tag") == expected), F.when(F.col("run_up") == 1, F.col("tag")).otherwise(ancestor(F.col("run_up") - 1, "anc_tags")) == "w:rPr"
    good = (
        F.when(F.col("run_up") < 0, ~leaf() & (F.coalesce(attr("w:author"), F.lit("")) != "") & attr("w:id").isNotNull() & only(ATTRIBUTES))
        .when(F.col("run_up") == 0, F.col("tag") == "w:r").otherwise((is_text & leaf() & only(["xml:space"])) | (in_props & (F.col("tag") != "w:rPrChange")))
    )
    value = F.when(F.coalesce(attr("w:val"), F.lit("1")).isin("1", "true", "on"), "1").when(attr("w:val").isin("0", "false", "off"), "0").otherwise(attr("w:val"))
    folded = F.when(F.col("tag").isin("w:b", "w:i"), F.map_concat(F.map_filter("attrs", lambda k, _: k != "w:val"), F.create_map(F.lit("w:val"), value))).otherwise(F.col("attrs"))
    # a subtree is told by its nodes in reading order with their depths
    prop = F.when(in_props & (F.col("run_up") >= 1), F.struct("id", F.col("run_up").alias("up"), "tag", F.sort_array(F.map_entries(folded)).alias("attrs"), F.coalesce("text", F.lit("")).alias("text")))
    told = inside.withColumns({"good": F.coalesce(good, F.lit(False)), "said": F.when(is_text, F.coalesce("text", F.lit(""))), "prop": prop})
    runs = told.where("run is not null").groupBy("doc", "alt", "p", "run").agg(
        F.bool_and("good").alias("good"), F.max("wrapper").alias("wrapper"), F.count_if((F.col("run_up") == 1) & (F.col("tag") == "w:rPr")).alias("heads"),
        in_order("said").alias("said"), F.to_json(F.transform(F.sort_array(F.collect_list("prop")), lambda x: x.dropFields("id"))).alias("props"),
    )
    heads = inside.where("run_up < 0").select("doc", "alt", "p", F.col("id").alias("wrapper"), F.coalesce(good, F.lit(False)).alias("fine"), F.to_json(F.struct("tag", attr("w:author").alias("author"), date().alias("date"))).alias("context"))
    runs = runs.join(heads.drop("fine"), ["doc", "alt", "p", "wrapper"], "left").withColumn("key", F.concat_ws("\u001f", F.coalesce("context", F.lit("")), "props"))
    fine = F.col("good") & (F.col("heads") <= 1) & (F.col("said") != "")
    told = runs.groupBy("doc", "alt", "p").agg(F.bool_and(fine).alias("good"), F.sort_array(F.collect_list(F.struct("run", "key", "said"))).alias("runs"))
    # neighbours of one context and look are one stretch
    none = F.array().cast("array<struct<key:string,said:string>>")

    def merge(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        joined_ = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(r["key"].alias("key"), F.concat(last["said"], r["said"]).alias("said"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["key"] == r["key"]), joined_).otherwise(F.concat(done, F.array(F.struct(r["key"].alias("key"), r["said"].alias("said")))))

    told = told.withColumn("runs", F.aggregate("runs", none, merge))
    wrong = heads.groupBy("doc", "alt", "p").agg(F.bool_and("fine").alias("fine"))
    per = used.join(told, ["doc", "alt", "p"], "left").join(wrong, ["doc", "alt", "p"], "left")
    per = per.withColumn("ok", F.coalesce("good", F.lit(False)) & F.coalesce("fine", F.lit(True)))
    out = per.groupBy("doc", "alt", "tag").agg(F.bool_and("ok").alias("ok"), F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("ordinal", "runs")))).cast("binary"), 256).alias("digest"))
    return out.where("ok").join(odd, ["doc", "alt", "tag"], "left_anti").select("doc", "alt", "tag", "digest")


def same_text(body: DataFrame) -> DataFrame:
    """(doc, alt, tag), doc a pair, of revisions that only were joined or split anew."""
    before, after = sides(signatures(body))
    return before.join(after, ["doc", "alt", "tag", "digest"]).select("doc", "alt", F.regexp_replace("tag", "^w:", "").alias("tag"))


# growth of pending insertions

STATE = "struct<kind:string,author:string,date:string>"


def _context() -> Column:
    return F.struct(F.col("tag").alias("kind"), attr("w:author").alias("author"), date().alias("date"))


def insertions(body: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the body's insertions that hold something: (doc, context, n, supported); the record
    (doc, context, id, text, state) of what they hold, text null where it isn't plain; and
    (doc, known) the contexts of all revisions."""
    parent = F.get("anc_tags", F.lit(0))
    rows = body.where(~F.col("alt_branch"))
    revs = rows.where(F.col("tag").isin(*REVISIONS)).withColumn("context", _context())
    known = revs.groupBy("doc").agg(F.collect_set("context").alias("known"))
    own = revs.where("tag = 'w:ins'").where(~leaf() | F.coalesce(~parent.endswith("Pr"), F.lit(True)))
    nested = under(*REVISIONS)
    complete = lambda c: (F.coalesce(c["author"], F.lit("")) != "") & (F.coalesce(c["date"], F.lit("")) != "")
    heads = own.select("doc", "id", "context", nested.alias("nested"), parent.eqNullSafe("w:p").alias("direct"), complete(F.col("context")).alias("complete"))
    # what hangs in revisions alone, up to an outermost insertion that stands in a paragraph
    chain = F.filter(F.transform("anc_tags", lambda t, i: F.struct(i.alias("i"), t.isin(*REVISIONS).alias("rev"))), lambda x: ~x["rev"])
    depth = F.coalesce(F.get(chain, F.lit(0))["i"], F.size("anc_tags"))  # revisions right above it
    items = rows.where(~F.col("tag").isin(*REVISIONS, *MARKERS)).withColumn("up", depth).where("up >= 1")
    items = items.withColumn("outer", F.get("anc_ids", F.col("up") - 1)).join(heads.where("direct and not nested").select("doc", F.col("id").alias("outer"), "context"), ["doc", "outer"])
    states = items.select("doc", "id", F.posexplode(F.slice("anc_ids", 1, F.col("up"))).alias("k", "rev")).join(revs.select("doc", F.col("id").alias("rev"), F.col("context").alias("s")), ["doc", "rev"])
    states = states.groupBy("doc", "id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("k"), "s"))), lambda x: x["s"]).alias("state"))
    items = items.select("doc", "id", "outer", "context", "tag").join(states, ["doc", "id"])
    # a run is plain if it holds properties without a former state, and text of its kind
    down = rows.withColumn("run", owner("w:r")).where("run is not null").withColumn("up", F.array_position("anc_tags", "w:r").cast("int"))
    top = F.when(F.col("up") == 1, F.col("tag")).otherwise(ancestor(F.col("up") - 1, "anc_tags"))
    down = down.join(items.where("tag = 'w:r'").select("doc", F.col("id").alias("run"), F.exists("state", lambda s: s["kind"].isin("w:del", "w:moveFrom")).alias("gone")), ["doc", "run"])
    is_text = (F.col("up") == 1) & (F.col("tag") == F.when(F.col("gone"), "w:delText").otherwise("w:t"))
    unadorned = F.size(F.array_except(F.map_keys("attrs"), F.array(F.lit("xml:space")))) == 0
    good = F.when(top == "w:rPr", F.col("tag") != "w:rPrChange").when(top == "w:lastRenderedPageBreak", True).otherwise(is_text & leaf() & unadorned)
    plain = down.withColumns({"good": F.coalesce(good, F.lit(False)), "said": F.when(is_text, F.coalesce("text", F.lit("")))}).groupBy("doc", F.col("run").alias("id")).agg(
        F.bool_and("good").alias("good"), in_order("said").alias("said")
    )
    record = items.join(plain, ["doc", "id"], "left")
    text = F.when(F.col("tag") == "w:r", F.when(F.coalesce("good", F.lit(True)), F.coalesce("said", F.lit(""))))
    record = record.select("doc", "context", "id", text.alias("text"), "state")
    elsewhere = heads.where("not direct and not nested").select("doc", "context", "id", F.lit(None).cast("string").alias("text"), F.array("context").alias("state"))
    record = record.unionByName(elsewhere)
    inner = F.slice("state", 2, F.greatest(F.size("state") - 1, F.lit(0)))
    odd = F.col("text").isNull() | F.exists("state", lambda s: ~complete(s) | ~s["kind"].isin("w:ins", "w:del")) | F.exists(inner, lambda s: s["kind"] == "w:ins")
    read = record.groupBy("doc", "context").agg(F.bool_or(odd).alias("odd"))
    # each outermost insertion must show something
    shown_ = items.join(plain, ["doc", "id"], "left").groupBy("doc", F.col("outer").alias("id")).agg(F.max(F.length(F.coalesce("said", F.lit("")))).alias("size"))
    checked = heads.join(shown_, ["doc", "id"], "left")
    fine = F.col("direct") & ~F.col("nested") & F.col("complete") & (F.coalesce("size", F.lit(0)) > 0)
    kinds = checked.groupBy("doc", "context").agg(F.count("*").alias("n"), F.bool_and(fine).alias("fine")).join(read, ["doc", "context"], "left")
    return kinds.select("doc", "context", "n", (F.col("fine") & ~F.coalesce("odd", F.lit(False))).alias("supported")), record, known


def characters(items: Column) -> Column:
    """Each character of (text, state) items with the state, as one string a character."""
    of = lambda x: F.transform(F.filter(F.split(x["text"], ""), lambda c: c != ""), lambda c: F.concat(c, F.to_json(x["state"])))
    return F.flatten(F.transform(items, of))


def growth(body: DataFrame) -> DataFrame:
    """FID011: characters that an edit added under a context which the source's insertions have,
    next to all of the source's own, once what has a new context is rejected."""
    kinds, record, known = insertions(body)
    k1, _ = sides(kinds.where("supported"))
    r1, r2 = sides(record)
    source_known, _ = sides(known)
    item = F.struct("id", "text", "state")
    old = r1.join(k1.select("doc", "context"), ["doc", "context"]).groupBy("doc", "context").agg(F.sort_array(F.collect_list(item)).alias("old"))
    new = r2.groupBy("doc", "context").agg(F.sort_array(F.collect_list(item)).alias("new"))
    both = old.join(new, ["doc", "context"], "left").join(source_known, "doc")
    is_new = lambda s: ~F.array_contains("known", s)
    kept = F.filter(F.coalesce("new", F.array().cast(f"array<struct<id:int,text:string,state:array<{STATE}>>>")), lambda x: ~F.exists(x["state"], lambda s: is_new(s) & s["kind"].isin(*INSERTED)))
    kept = F.transform(kept, lambda x: F.struct(x["text"].alias("text"), F.filter(x["state"], lambda s: ~is_new(s)).alias("state")))
    both = both.withColumn("kept", kept)
    unread = F.exists("kept", lambda x: x["text"].isNull() | (F.size(x["state"]) == 0) | ~F.get(x["state"], F.lit(0)).eqNullSafe(F.col("context")))
    both = both.where(~unread).withColumns({"wanted": characters(F.col("old")), "given": characters(F.col("kept"))})
    both = both.withColumn("s", budget.surplus(F.col("wanted"), F.col("given"))).where("s.whole and size(s.extra) > 0")
    alone = F.to_json(F.array("context"))
    both = both.where(~F.exists("s.extra", lambda c: F.substring(c, 2, 1 << 30) != alone))
    added = F.array_join(F.transform("s.extra", lambda c: F.substring(c, 1, 1)), "")
    said = F.concat(
        F.size("s.extra"), F.lit(" more character(s) stand under a pending insertion of the source by "), F.col("context.author"), F.lit(" of "), F.col("context.date"),
        F.lit(", not under one of their own: "), T.snippet(added, 120),
    )
    return D.found(both, "FID011", "warn", said, added, part="word/document.xml")


# notes that lose their revisions


def note_revision_losses(bodies: DataFrame) -> DataFrame:
    """FID010: of bodies(doc, part, item, text, kind), a row for each revision kind of a note
    (null: none), text with what is deleted: notes whose text and number are as before, but
    fewer of which have a kind."""
    notes = bodies.where("text <> ''")
    per = notes.groupBy("doc", "part", "text").agg(F.count_distinct("item").alias("notes"))
    kinds = notes.where("kind is not null").groupBy("doc", "part", "text", "kind").agg(F.count_distinct("item").alias("n"))
    by = ["doc", "part", "text"]
    (n1, n2), (k1, k2) = sides(per), sides(kinds)
    alike = n1.join(n2, [*by, "notes"]).select(*by)
    both = k1.join(alike, by).join(k2.withColumnRenamed("n", "m"), [*by, "kind"], "left").na.fill(0, ["m"]).where("m < n")
    said = F.concat(F.lit("tracked "), named(NAMES, F.col("kind")), F.lit("s are gone from "), F.col("n") - F.col("m"), F.lit(" of "), "n", F.lit(" source note(s) whose text is as before: "), T.snippet(F.col("text"), 80))
    return D.found(both, "FID010", "error", said, F.col("text"))


def note_kinds(nodes: DataFrame) -> DataFrame:
    """(doc, part, item, text, kind) of footnotes and endnotes; see note_revision_losses."""
    tag = F.when(F.col("part") == "word/footnotes.xml", "w:footnote").when(F.col("part") == "word/endnotes.xml", "w:endnote")
    rows = nodes.where("not alt_branch").withColumn("item_tag", tag).where("item_tag is not null")
    items = rows.where("tag = item_tag and depth = 1").where(~F.coalesce(attr("w:type"), F.lit("")).isin("separator", "continuationSeparator", "continuationNotice")).select("doc", "part", F.col("id").alias("item"))
    inside = rows.withColumn("item", F.get("anc_ids", F.array_position("anc_tags", F.col("item_tag")).cast("int") - 1)).where("item is not null").join(items, ["doc", "part", "item"], "left_semi")
    keys = ["doc", "part", "item"]
    texts = joined(pieces(inside), keys, "true", "text")
    kinds = inside.where(F.col("tag").isin(*INLINE)).select(*keys, F.col("tag").alias("kind")).distinct()
    return items.join(texts, keys, "left").join(kinds, keys, "left").na.fill("", ["text"])


# replacements wider than the change


def replacements(nodes: DataFrame, stories: DataFrame) -> DataFrame:
    """(doc, story, deletion, insertion, deleted, inserted): a deletion and an insertion of one
    author that touch in a paragraph; the first two are (kind, author, date)."""
    rows = pieces(nodes.where("not alt_branch")).where("p is not null")
    drawn = F.col("tag").isin(*CHARACTERS)
    rows = rows.where(~drawn | (F.col("shown") != ""))
    gone, new = (F.array_position("anc_tags", k).cast("int") for k in ("w:del", "w:ins"))
    state = F.when((gone > 0) & ((F.col("tag") == "w:delText") | drawn), "w:del").when((new > 0) & (gone == 0) & ((F.col("tag") == "w:t") | drawn), "w:ins")
    rev = F.when(state == "w:del", F.get("anc_ids", gone - 1)).when(state == "w:ins", F.get("anc_ids", new - 1))
    rows = rows.select("doc", "part", "p", "id", "shown", rev.alias("rev"))
    context = F.struct(F.col("tag").alias("kind"), F.coalesce(attr("w:author"), F.lit("")).alias("author"), F.coalesce(date(), F.lit("")).alias("date"))
    revs = nodes.where(F.col("tag").isin(*INLINE)).select("doc", "part", F.col("id").alias("rev"), context.alias("context"))
    rows = rows.join(revs, ["doc", "part", "rev"], "left")
    w = Window.partitionBy("doc", "part", "p").orderBy("id")  # one paragraph
    change = F.when((F.row_number().over(w) > 1) & F.lag("context").over(w).eqNullSafe(F.col("context")), 0).otherwise(1)
    rows = rows.withColumn("change", change).withColumn("run", F.sum("change").over(w))
    runs = rows.groupBy("doc", "part", "p", "run").agg(F.any_value("context").alias("context"), in_order("shown").alias("said"))
    after = runs.select("doc", "part", "p", (F.col("run") - 1).alias("run"), F.col("context").alias("context2"), F.col("said").alias("said2"))
    pairs = runs.join(after, ["doc", "part", "p", "run"]).where("context.kind <> context2.kind and context.author = context2.author").join(stories, ["doc", "part"])
    first = F.col("context.kind") == "w:del"
    either = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return pairs.select("doc", "story", either("context", "context2").alias("deletion"), either("context2", "context").alias("insertion"), either("said", "said2").alias("deleted"), either("said2", "said").alias("inserted"))


def wide_replacements(nodes: DataFrame, stories: DataFrame) -> DataFrame:
    """FID013: replacements that an edit added and that carry at least UNCHANGED_WORDS words
    which did not change, more than those that did."""
    _, new = sides(replacements(nodes, stories))
    context = F.struct(F.col("tag").alias("kind"), F.coalesce(attr("w:author"), F.lit("")).alias("author"), F.coalesce(date(), F.lit("")).alias("date"))
    source, _ = sides(nodes.where(F.col("tag").isin(*REVISIONS)).join(stories, ["doc", "part"]).select("doc", "story", context.alias("context")))
    source = source.distinct()
    for name in ("deletion", "insertion"):
        new = new.join(source.withColumnRenamed("context", name), ["doc", "story", name], "left_anti")
    words = lambda c: F.filter(F.split(T.squeezed(F.col(c)), " "), lambda x: x != "")
    new = new.withColumns({"a": words("deleted"), "b": words("inserted")}).withColumn("head", T.common_prefix(F.col("a"), F.col("b")))
    rest = lambda c: F.reverse(F.slice(c, F.col("head") + 1, F.size(c)))
    n = F.col("head") + T.common_prefix(rest("a"), rest("b"))
    new = new.withColumn("same", n).withColumn("other", F.greatest(F.size("a"), F.size("b")) - F.col("same"))
    new = new.where((F.col("same") >= UNCHANGED_WORDS) & (F.col("same") > F.col("other")))
    author = F.col("deletion.author")
    said = F.concat(
        F.col("story"), F.lit(": a tracked replacement "), F.when(author != "", F.concat(F.lit("by "), author)).otherwise("with no author"), F.lit(" strikes and adds again "), "same",
        F.lit(" words as they were, around "), "other", F.lit(" changed: '"), T.snippet(T.squeezed(F.col("deleted")), 60), F.lit("' -> '"), T.snippet(T.squeezed(F.col("inserted")), 60), F.lit("'"),
    )
    return D.found(new, "FID013", "warn", said, author, where=F.col("story"))
