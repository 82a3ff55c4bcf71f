"""Secret scans with corpus-wide ownership frequency (operator 1).

Main path: DataFrame functions only. Every whole text is searched for three base kinds
of credentials and three further kinds of candidates. Candidate values leave the text
as SHA-256 hashes. Hashes are counted by distinct repositories and owners, in two
aggregations that combine before they shuffle, so a value in a third of all rows costs
one row per task. A value that at most ``most_owners`` owners hold in at most ``most_repos``
repositories and that looks random is owner-specific (live-looking). One that more owners hold is a copied example,
and one that its owner keeps in more repositories is a template or a fixture of theirs.
Base spans always stay; spans of the further kinds are added where their value is live-looking.
A private key is its whole PEM block, and the value that is counted its base64 body.

Positions come without a user function: ``split`` gives the text between matches and
``regexp_extract_all`` the matches; running sums of their lengths are the offsets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrachron.plans.tables import written

#: Fixed patterns: kind, pattern, group with the value, least characters of the value.
BASE = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]{16,})", 1, 20),
    ("hex", r"([0-9a-f]{24,})", 1, 24),
]
#: A key with its header fields, base64 body (the value; lines may end in a written-out \\n) and footer; a body without a footer goes on as long as its lines are long.
_PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[\s\\rn]{0,8}[A-Z][A-Za-z]*-[A-Za-z-]+: ?[^\r\n\\]{0,200}){0,6}"
    r"([A-Za-z0-9+/=\s\\]++(?=-----END )|\s{0,8}[A-Za-z0-9+/=\\]{20,}+(?:\s{1,8}[A-Za-z0-9+/=\\]{40,}+){0,400})"
    r"(?:-----END [A-Z ]*PRIVATE KEY-----)?"
)
FURTHER = [
    ("vendor", r"(gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*)", 1, 15),
    ("private_key", _PEM, 1, 20),
    ("opaque", r"(?<![A-Za-z0-9_-])((?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{20,})", 1, 20),
]
KINDS = [k for k, *_ in BASE + FURTHER]


def _found(text: Column, kind: str, pattern: str, group: int) -> Column:
    """Struct of the lengths between matches, of matches and of values, value hashes, and whether values look random."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    if kind == "private_key":  # a copy with other line ends is the same key
        values = F.transform(values, lambda v: F.regexp_replace(v, r"\\[rn]|[\s\\]", ""))
    random = lambda v: (F.size(F.array_distinct(F.split(v, ""))) >= 8) & v.rlike("[0-9]")
    return F.when(
        text.rlike(pattern),
        F.struct(
            F.lit(kind).alias("kind"),
            F.transform(F.split(text, pattern, -1), F.length).alias("between"),
            F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length).alias("chars"),
            F.transform(values, lambda v: F.struct(F.length(v).alias("size"), F.sha2(v, 256).alias("hash"), random(v).alias("random"))).alias("values"),
        ),
    )


def candidates(rows: DataFrame) -> DataFrame:
    """(uid, text, repo, owner, ...) -> the same without text, with ``found``: one struct per kind that occurs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.array_compact(F.array(*[_found(text, k, p, g) for k, p, g, _ in BASE + FURTHER]))
    return rows.select(*[c for c in rows.columns if c != "text"], found.alias("found"))


def spans_of(found: DataFrame, most_owners: int = 1, most_repos: int = 4) -> DataFrame:
    """Output of :func:`candidates` -> uid, kind, rank (of the kind), start, end, base, live: one row per span that holds.

    Only hashes that may be live are joined back; those of widely copied values meet nothing, and
    AQE splits a value that very many spans of one owner have.
    """
    each = found.select("uid", "repo", "owner", F.inline("found")).select("uid", "repo", "owner", "kind", F.posexplode(F.arrays_zip("between", "chars", "values")).alias("at", "m"))
    each = each.where(F.col("m.chars").isNotNull())
    before = Window.partitionBy("uid", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.between") + F.col("m.chars")).over(before)
    each = each.select("uid", "repo", "owner", "kind", end.alias("end"), (end - F.col("m.chars")).alias("start"), "m.values.*")
    least = reduce(lambda c, x: c.when(F.col("kind") == x[0], x[3]), BASE + FURTHER, F.when(F.lit(False), 0))
    rank = reduce(lambda c, x: c.when(F.col("kind") == x[1], x[0]), enumerate(KINDS), F.when(F.lit(False), 0))
    each = each.where(F.col("size") >= least).withColumn("rank", rank)
    held = each.groupBy("hash", "repo", "owner").agg(F.lit(1).alias("one"))
    owned = held.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos"))
    few = owned.where((F.col("owners") <= most_owners) & (F.col("repos") <= most_repos)).select("hash", F.lit(True).alias("few"))
    out = each.join(few, "hash", "left").withColumn("live", F.col("random") & F.coalesce("few", F.lit(False)))
    base = F.col("rank") < len(BASE)
    return out.where(base | F.col("live")).select("uid", "kind", "rank", "start", "end", base.alias("base"), "live")


def _rows(docs: DataFrame, repo: Column, owner: Column) -> DataFrame:
    known = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), known(repo).alias("repo"), known(owner).alias("owner"))


def secret_spans(docs: DataFrame, repo: Column, owner: Column, most_owners: int = 1, most_repos: int = 4) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied.

    Offsets are code points, ends exclusive. Null texts are empty: no spans, the
    digest of an empty string. Null repositories and owners count as one nameless one.
    Rows with equal or null ids each have their own result; further columns are ignored, whatever
    their names; no rows give no rows. A private key's span holds at most six header fields of
    200 characters each, and without a footer at most 400 lines: longer matches would overrun a task's stack.
    """
    found = written(candidates(_rows(docs, repo, owner)), "secrets-found")
    some = found.where(F.size("found") > 0)
    spans = spans_of(some, most_owners, most_repos)
    shown = F.struct("start", "rank", F.concat_ws(":", "kind", "start", "end").alias("s"))
    join = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["s"]), ",")
    per = spans.groupBy("uid").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k, *_ in BASE],
        join(F.collect_list(F.when(F.col("base"), shown))).alias("base"),
        join(F.collect_list(shown)).alias("spans"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_copied"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    empty = lambda c: F.coalesce(c, F.lit(""))
    out = found.select("uid", "doc_id").join(per, "uid", "left")
    return out.select("doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"), F.sha2(empty("base"), 256).alias("base_sha256"), empty("spans").alias("spans"), zero("n_live"), zero("n_copied"))


def redacted(docs: DataFrame, repo: Column, owner: Column, most_owners: int = 1, most_repos: int = 4, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of ``docs``; every span of :func:`secret_spans` in ``text`` is replaced by ``mark`` (overlapping spans by one).

    A column n_chars, if there is one, follows the new text. Null and empty texts stay as
    they are; repeated rows each stay and are changed alike; further columns may have any
    names; null repositories and owners count as one nameless one. Only documents with a
    candidate are shuffled.
    """
    any_ = F.coalesce(reduce(lambda a, b: a | b, [F.col("text").rlike(p) for _, p, _, _ in BASE + FURTHER]), F.lit(False))
    some = written(docs.where(any_).select(F.monotonically_increasing_id().alias("uid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(repo.cast("string"), F.lit("")).alias("repo"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner")), "secrets-rows")
    found = candidates(some.select("uid", F.col("row.text").alias("text"), "repo", "owner"))
    per = spans_of(found, most_owners, most_repos).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("s"))
    text = F.col("row.text")
    zero = F.lit(0).cast("long")
    first = F.struct(zero.alias("end"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, s: Column) -> Column:
        part = F.concat(F.substr(text, (a["end"] + 1).cast("int"), (s["start"] - a["end"]).cast("int")), F.lit(mark))
        parts = F.when(s["start"] >= a["end"], F.array_append(a["parts"], part)).otherwise(a["parts"])
        return F.struct(F.greatest(a["end"], s["end"]).alias("end"), parts.alias("parts"))

    done = F.aggregate("s", first, step)
    rebuilt = some.join(per, "uid", "left").withColumn("done", done)
    new = F.when(F.col("s").isNull(), text).otherwise(F.concat(F.array_join("done.parts", ""), F.substr(text, (F.col("done.end") + 1).cast("int"))))
    cols = []
    for c, kind in docs.dtypes:
        value = new if c == "text" else F.length(new).cast(kind) if c == "n_chars" else F.col(f"row.`{c}`")
        cols.append(value.alias(c))
    return docs.where(~any_).unionByName(rebuilt.select(*cols))
