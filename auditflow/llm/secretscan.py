"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Patterns find candidate spans of every text: a text splits at a pattern's matches, and running
sums over the lengths of gaps and matches, one row a match, are the positions.  The hash of each
candidate's value is then counted over the corpus by distinct repositories and owners.  A value
that several owners hold, or several repositories of one owner, is an example that was copied; one
that a single owner holds in few repositories and that has the variety of a generated key looks
live.  Both verdicts are added as spans of their own, beside the ones that the patterns found.

Values are counted in stages, each combined before its shuffle (value, owner, repository; value,
owner; value), so a value that a third of all texts hold is a few rows a task.

Defined cases: null or empty text has no spans.  Null owners are one owner; a repository whose
source is null is another than one whose language is.  Repeated rows have the same spans each, and
count as one owner.  An empty table has no rows.  Very long texts cost time in proportion to their
length and matches.  Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .columns import quoted, whole
from .store import materialize

#: The kinds in order, and their patterns.
KINDS = ("assign", "access", "hex", "opaque", "example", "live")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Further candidates: long opaque strings with a digit and letters of both cases.
OPAQUE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[0-9A-Z_-]*[a-z])(?=[0-9a-z_-]*[A-Z])[A-Za-z0-9_-]{32,}"
ASSIGN_CHARS = 6
#: A value of so many owners or repositories is an example; a live-looking one has one owner and so many different characters.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, LIVE_CHARS = 3, 3, 8

_HITS = "array<struct<ord:int,at:int,gap:int,hit:int,value:string>>"


def _hits(text: Column, ord_: int, pattern: str, group: int) -> Column:
    """array<struct<ord, at, gap, hit, value>> of a kind: the match's number, the lengths of what
    stands before it and of itself, and what group holds."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = (lambda h: F.regexp_extract(h, pattern, group)) if group else (lambda h: h)
    found = F.zip_with(
        F.slice(F.split(text, pattern, -1), 1, F.size(hits)), F.transform(hits, lambda h, i: F.struct(i.alias("i"), h.alias("h"))),
        lambda gap, x: F.struct(F.lit(ord_).alias("ord"), x["i"].alias("at"), F.length(gap).alias("gap"), F.length(x["h"]).alias("hit"), value(x["h"]).alias("value")),
    )
    return F.coalesce(F.when(F.regexp_like(text, F.lit(pattern)), found), F.array().cast(_HITS))


def _listing(spans: Column) -> Column:
    """kind:start:end by start, then kind in order, comma-joined; spans: structs start, ord, stop."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["ord"]), s["start"], s["stop"])), ",")


def matches(docs: DataFrame, doc_id: str, text: str, owner: Column, repository: Column) -> DataFrame:
    """(row, doc_id, owner, repository, hits): what the patterns match in every row."""
    body = docs.select(quoted(doc_id).alias("doc_id"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), whole(quoted(text)).alias("text"))
    t = F.col("text")
    hits = F.concat(_hits(t, 0, ASSIGN, 1), _hits(t, 1, ACCESS, 0), _hits(t, 2, HEX, 0), _hits(t, 3, OPAQUE, 0))
    return body.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository", hits.alias("hits"))


def candidates(found: DataFrame) -> DataFrame:
    """(row, owner, repository, ord, start, stop, value): the spans of matches(...) that hold."""
    each = found.filter(F.size("hits") > 0).select("row", "owner", "repository", F.explode("hits").alias("h")).select("row", "owner", "repository", "h.*")
    stop = F.sum(F.col("gap") + F.col("hit")).over(Window.partitionBy("row", "ord").orderBy("at")).cast("int")
    spans = each.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("hit"))
    return spans.filter((F.col("ord") != 0) | (F.length("value") >= ASSIGN_CHARS)).select("row", "owner", "repository", "ord", "start", "stop", "value")


def ownership(values: DataFrame) -> DataFrame:
    """(hash, owners, repositories) of (hash, owner, repository): distinct ones of each value."""
    each = values.select("hash", "owner", "repository").distinct()
    by_owner = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))


def verdict(owners: Column, repositories: Column, varied: Column) -> Column:
    """The added span's kind, as its place in KINDS, or null."""
    copied = (owners >= EXAMPLE_OWNERS) | (repositories >= EXAMPLE_REPOSITORIES)
    return F.when(copied, F.lit(4)).when((owners == 1) & varied, F.lit(5))


def scan_secrets(docs: DataFrame, doc_id="doc_id", text="text", owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_example, n_live) of every row.

    owner and repository default to the column source, and source with lang.
    """
    owner = quoted("source") if owner is None else owner
    repository = F.to_json(F.struct(quoted("source").alias("source"), quoted("lang").alias("lang"))) if repository is None else repository
    found = materialize(matches(docs, doc_id, text, owner, repository))
    each = materialize(candidates(found))
    value = F.col("value")
    held = each.select("row", "owner", "repository", F.sha2(value, 256).alias("hash"), (F.col("stop") - F.length(value)).alias("start"), "stop", (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARS).alias("varied"))
    known = ownership(held).select(F.reverse("hash").alias("k"), "owners", "repositories")  # dealt anew, so that a hot value is split
    judged = held.join(known, F.reverse("hash") == F.col("k")).select("row", verdict(F.col("owners"), F.col("repositories"), F.col("varied")).alias("ord"), "start", "stop").filter("ord IS NOT NULL").distinct()
    span = F.struct("start", "ord", "stop")
    spans = each.select("row", "ord", "start", "stop").unionByName(judged.select("row", "ord", "start", "stop")).groupBy("row").agg(F.collect_list(span).alias("s"))
    none = F.array().cast("array<struct<start:int,ord:int,stop:int>>")
    both = found.select("row", "doc_id").join(spans, "row", "left").select("doc_id", F.coalesce("s", none).alias("s"))
    count = lambda i: F.size(F.filter("s", lambda x: x["ord"] == i)).cast("long")
    return both.select(
        "doc_id", *(count(i).alias(f"n_{KINDS[i]}") for i in range(3)), F.sha2(_listing(F.filter("s", lambda x: x["ord"] < 3)), 256).alias("base_sha256"),
        _listing(F.col("s")).alias("spans"), *(count(i).alias(f"n_{KINDS[i]}") for i in (4, 5)),
    )
