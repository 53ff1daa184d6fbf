"""What can be repaired in a package without a guess, decided over the fact tables, and the
test that a repair did what it should. No bytes are changed here: a decision says what to
change, or why not.

decisions(doc, rule, subject, action, part, node, old, new, reason): action is 'change',
'add' or 'refuse'.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import forest, relations
from . import document_rules as D
from .reading import REVISIONS

EXTENDED = D.MICROSOFT + "2011/relationships/commentsExtended"
# The three marks of an anchored comment.
MARKS = ["w:commentRangeStart", "w:commentRangeEnd", "w:commentReference"]


def attr(name: str) -> Column:
    return F.col("attrs")[name]


def decided(rows: DataFrame, rule: str, action: Column | str, subject: Column, reason: Column | None = None, part: Column | None = None, node: Column | None = None, old: Column | None = None, new: Column | None = None) -> DataFrame:
    none = F.lit(None)
    columns = {"action": F.lit(action) if isinstance(action, str) else action, "part": part, "node": node, "old": old, "new": new, "reason": reason}
    kinds = {"node": "int"}
    return rows.select("doc", F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), *((none if c is None else c).cast(kinds.get(n, "string")).alias(n) for n, c in columns.items()))


# comment threads


def comments(f: D.Facts) -> DataFrame:
    """(doc, cid, para, times): comments by id, with the paragraph that thread links name (that
    of the last one's paragraph) and how often the id is defined."""
    rows = f.nodes.where("tag = 'w:comment' and depth = 1 and part = 'word/comments.xml'").select("doc", "part", "id", attr("w:id").alias("cid"))
    inner = f.nodes.where("tag = 'w:p' and part = 'word/comments.xml'").select("doc", F.col("id").alias("p"), attr("w14:paraId").alias("para"), F.explode("anc_ids").alias("id"))
    last = inner.join(rows.select("doc", "id"), ["doc", "id"]).groupBy("doc", "id").agg(F.upper(F.max_by("para", "p")).alias("para"))
    each = rows.join(last, ["doc", "id"], "left").withColumn("para", F.nullif("para", F.lit("")))
    return each.groupBy("doc", "cid").agg(F.min_by("para", "id").alias("para"), F.count("*").alias("times"), F.min("id").alias("at")).where("cid is not null")


def links(f: D.Facts) -> DataFrame:
    """(doc, para, parents): what the one part of extended comments says of a paragraph, an
    empty name where it names no parent."""
    to = f.rels.where(F.col("type") == EXTENDED).where("mode is null or lower(mode) <> 'external'").join(f.main.withColumnRenamed("part", "owner"), ["doc", "owner"])
    files = f.members.where("part is not null").select("doc", F.col("part").alias("name"))
    found = to.select("doc", "ord", F.explode("candidates").alias("name")).join(files, ["doc", "name"]).groupBy("doc", "ord").agg(F.min("name").alias("name"))
    one = to.groupBy("doc").agg(F.count("*").alias("n")).where("n = 1").join(found, "doc").select("doc", F.col("name").alias("part"))
    rows = f.nodes.where("tag = 'w15:commentEx'").join(one, ["doc", "part"])
    up = lambda name: F.upper(F.coalesce(attr(name), F.lit("")))
    told = rows.groupBy("doc", up("w15:paraId").alias("para")).agg(F.collect_list(up("w15:paraIdParent")).alias("parents"))
    # a document without such a part still has its row, so that a missing link is told from it
    return told.unionByName(one.select("doc", F.lit(None).cast("string").alias("para"), F.array().cast("array<string>").alias("parents")))


def threads(f: D.Facts) -> DataFrame:
    """(doc, cid, para, times, parent, why, root, depth, state): each comment's parent, or why
    none is certain; root, depth and state as forest.rooted gives them."""
    own, told = comments(f), relations.cut(links(f))
    many = own.where("para is not null").groupBy("doc", "para").agg(F.count("*").alias("same"), F.min("cid").alias("of"))
    has = told.where("para is null").select("doc", F.lit(True).alias("has"))
    rows = own.join(many.select("doc", "para", "same"), ["doc", "para"], "left").join(has, "doc", "left").join(told.where("para is not null"), ["doc", "para"], "left")
    named = F.get("parents", F.lit(0))
    rows = rows.withColumn("up", F.when((F.size("parents") == 1) & (named != ""), named))
    rows = rows.join(many.select("doc", F.col("para").alias("up"), F.col("same").alias("ups"), F.col("of").alias("parent")), ["doc", "up"], "left")
    why = (
        F.when(F.col("para").isNull(), "no paragraph id links it to a parent").when(F.col("same") > 1, "several comments have its paragraph id")
        .when(F.col("has").isNull(), "no single part of extended comments links it").when(F.size("parents") > 1, "its paragraph is described more than once")
        .when(F.col("up").isNotNull() & (F.coalesce("ups", F.lit(0)) != 1), "its parent's paragraph id doesn't name one comment")
    )
    rows = relations.cut(rows.withColumn("why", why).withColumn("parent", F.when(F.col("why").isNull(), F.col("parent"))).select("doc", "cid", "para", "times", "at", "parent", "why"))
    tree = forest.rooted(rows.select("doc", "cid", "parent"), ["doc"], "cid", "parent").select("doc", "cid", "root", "depth", "state")
    return rows.join(tree, ["doc", "cid"])


def anchors(f: D.Facts) -> DataFrame:
    """(doc, cid, marks, stories, story, whole, boxed): the marks of a comment in the stories;
    whole: one of each kind in one story; boxed: some stand in alternate content."""
    rows = f.nodes.where(F.col("tag").isin(*MARKS)).join(D.story_parts(f), ["doc", "part"])
    per = rows.groupBy("doc", attr("w:id").alias("cid")).agg(
        F.count("*").alias("marks"), F.count_distinct("part").alias("stories"), F.min("part").alias("story"), F.count_distinct("tag").alias("kinds"),
        F.bool_or(F.array_contains("anc_tags", "mc:AlternateContent")).alias("boxed"),
    )
    return per.withColumn("whole", (F.col("marks") == 3) & (F.col("kinds") == 3) & (F.col("stories") == 1)).drop("kinds")


def reply_anchors(f: D.Facts, targets: DataFrame) -> DataFrame:
    """For targets(doc, subject), comments without an anchor: a reply whose parent tops its
    thread and is anchored once, as are the replies next to it, goes where its parent is."""
    tree = relations.cut(threads(f))
    placed = relations.cut(anchors(f))
    rows = targets.select("doc", F.col("subject").alias("cid")).distinct().join(tree, ["doc", "cid"], "left").join(placed, ["doc", "cid"], "left")
    up = tree.select("doc", F.col("cid").alias("parent"), F.col("parent").alias("grand"), F.col("why").alias("up_why"))
    home = placed.select("doc", F.col("cid").alias("parent"), F.col("story").alias("home"), F.col("whole").alias("up_whole"))
    rows = rows.join(up, ["doc", "parent"], "left").join(home, ["doc", "parent"], "left")
    # the other anchored replies of the thread must be where the parent is
    others = tree.join(placed, ["doc", "cid"]).where("parent is not null").join(home, ["doc", "parent"])
    astray = others.where("not whole or story <> home or not up_whole").groupBy("doc", "parent").agg(F.min("cid").alias("astray"))
    boxed = tree.join(placed.where("boxed"), ["doc", "cid"]).select("doc", F.explode(F.array("cid", "parent")).alias("cid")).where("cid is not null").distinct()
    rows = rows.join(astray, ["doc", "parent"], "left").join(boxed.select("doc", "cid", F.lit(True).alias("in_box")), ["doc", "cid"], "left")
    rows = rows.join(boxed.select("doc", F.col("cid").alias("parent"), F.lit(True).alias("up_box")), ["doc", "parent"], "left")
    reason = (
        F.when(F.col("times").isNull(), "no comment has this id").when(F.col("times") > 1, "several comments have this id")
        .when(F.coalesce("in_box", "up_box", F.lit(False)), "its thread has marks in alternate content, which is stored twice")
        .when(F.col("marks") > 0, "it has range marks but no reference").when(F.col("why").isNotNull(), F.col("why")).when(F.col("parent").isNull(), "it is no reply, so its place is lost")
        .when(F.col("up_why").isNotNull(), F.concat(F.lit("its parent's own link is unclear: "), "up_why")).when(F.col("grand").isNotNull(), "its parent is a reply itself")
        .when(~F.coalesce("up_whole", F.lit(False)), "its parent isn't anchored once, by three marks in one story")
        .when(F.col("astray").isNotNull(), F.concat(F.lit("reply "), "astray", F.lit(" of its thread isn't anchored with the parent")))
    )
    rows = rows.withColumn("reason", reason)
    return decided(rows, "anchor-replies", F.when(F.col("reason").isNull(), "add").otherwise("refuse"), F.col("cid"), F.col("reason"), F.when(F.col("reason").isNull(), F.col("home")), None, None, F.when(F.col("reason").isNull(), F.col("parent")))


# revision ids


def revision_ids(f: D.Facts, targets: DataFrame) -> DataFrame:
    """For targets(doc, subject), revision ids of the main part in use more than once: the first
    use keeps the id, the others get ids above all of the package, in reading order."""
    body = f.body
    changes = body.where(F.col("tag").isin(*REVISIONS)).withColumn("rid", attr("w:id")).where("rid is not null")
    uses = changes.groupBy("doc", "rid").agg(F.count("*").alias("n"))
    asked = targets.select("doc", F.col("subject").alias("rid")).distinct().join(uses, ["doc", "rid"], "left")
    # of more than two uses, two may be a paragraph's mark and its content, which rightly share one
    kinds = changes.where("tag in ('w:ins', 'w:del')").withColumn("who", F.to_json(F.struct("tag", attr("w:author"), attr("w:date"))))
    marks = kinds.withColumn("mark", (F.get("anc_tags", F.lit(0)) == "w:rPr") & (F.get("anc_tags", F.lit(1)) == "w:pPr"))
    p = F.when(F.col("mark"), F.get("anc_ids", F.lit(2))).otherwise(F.col("parent"))
    paired = marks.withColumn("p", p).groupBy("doc", "rid", "who", "p").agg(F.bool_or("mark").alias("a"), F.bool_or(~F.col("mark")).alias("b")).where("a and b").select("doc", "rid").distinct()
    asked = asked.join(paired.withColumn("pair", F.lit(True)), ["doc", "rid"], "left")
    reason = F.when(F.coalesce("n", F.lit(0)) < 2, "no repeated use").when(F.col("pair"), "two of its uses are a paragraph's mark and its content, which share one")
    asked = relations.cut(asked.withColumn("reason", reason))
    good = changes.join(asked.where("reason is null").select("doc", "rid"), ["doc", "rid"], "left_semi").select("doc", "part", "id", "rid")
    number = F.expr("try_cast(trim(attrs['w:id']) as bigint)")
    top = f.nodes.where(number.isNotNull()).groupBy("doc").agg(F.max(number).alias("top"))
    fresh = forest.fresh_ids(good, ["doc"], "rid", [F.col("id")], top).where("fresh is not null")
    return decided(fresh, "renumber-revisions", "change", F.col("rid"), None, F.col("part"), F.col("id"), F.col("rid"), F.col("fresh")).unionByName(
        decided(asked.where("reason is not null"), "renumber-revisions", "refuse", F.col("rid"), F.col("reason"))
    )


# content types


def content_types(f: D.Facts) -> DataFrame:
    """Related parts whose declared type isn't that of their relationship: the one Override is
    changed, or one is added."""
    wrong = D.wrong_related_types(f)
    over = f.types.where("kind = 'Override'").groupBy("doc", F.col("part_key").alias("part")).agg(F.count("*").alias("n"))
    rows = wrong.join(over, ["doc", "part"], "left")
    several = F.coalesce("n", F.lit(0)) > 1
    action = F.when(several, "refuse").when(F.col("n") == 1, "change").otherwise("add")
    return decided(rows, "content-type", action, F.col("part"), F.when(several, "several declarations name it"), F.lit("[content_types].xml"), None, F.col("media_type"), F.when(~several, T.media_type(F.col("wanted"))))


def decisions(f: D.Facts, findings: DataFrame) -> DataFrame:
    """What to do about CMT005, REV001 and PKG010 of check()'s findings."""
    of = lambda code: findings.where(F.col("code") == code).select("doc", "subject")
    tables = (relations.cut(t) for t in (reply_anchors(f, of("CMT005")), revision_ids(f, of("REV001")), content_types(f)))
    return reduce(DataFrame.unionByName, tables)


def verified(before: DataFrame, after: DataFrame, targets: DataFrame, key: tuple[str, ...] = ("code", "severity", "part", "where", "subject")) -> DataFrame:
    """(doc, ok, left, added, other): of the findings before and after a repair of targets(doc and
    key), how many targets are still there, how many findings are new, and how many that
    were no targets went, too; ok if none of these. Bags, so one of two equal ones counts."""
    keys = ["doc", *key]
    bag = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(n))
    names = [F.coalesce(k, F.lit("\u0000")).alias(k) for k in keys]
    a, b, t = (bag(df.select(*names), n) for df, n in ((before, "a"), (after, "b"), (targets, "t")))
    rows = a.join(b, keys, "full_outer").join(t, keys, "full_outer").na.fill(0, ["a", "b", "t"])
    left = F.greatest(F.lit(0), F.col("b") - F.greatest(F.lit(0), F.col("a") - F.col("t")))
    out = rows.groupBy("doc").agg(
        F.sum(F.when(F.col("t") > 0, F.least(left, F.col("t"))).otherwise(0)).alias("left"), F.sum(F.greatest(F.lit(0), F.col("b") - F.col("a"))).alias("added"),
        F.sum(F.greatest(F.lit(0), F.col("a") - F.col("b") - F.col("t"))).alias("other"),
    )
    return out.select("doc", ((F.col("left") == 0) & (F.col("added") == 0) & (F.col("other") == 0)).alias("ok"), "left", "added", "other")
