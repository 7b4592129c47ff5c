"""Secret scans by corpus-wide ownership frequency, in DataFrame expressions only.

Candidates are found in every text, once, and written with their rows. Their
hashes are then counted over the whole corpus by distinct repositories and
owners. A value that many owners hold, or several owners in many repositories,
is a copied example; a value that looks random and stays with one owner,
wherever that one repeats it, or in few repositories of few, is a live
credential of theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import before, carried, chunks, let, part, restored, stage

#: kind, pattern, group that is the value, its least length; in the order in which kinds are listed.
KINDS = (
    ("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("owned", "(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_-])", 0, 20),
)
#: Found faster and the same: a run that is too short never hides a longer one in these.
SAME = {"access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}"}
#: A value that so many owners hold is a widely copied example; one of several owners, if so many repositories do.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 10
#: A value in so many rows is met by broadcast, any other in a join.
HOT_ROWS = 10_000
SPAN = "struct<start:bigint,k:int,kind:string,end:bigint,value:string>"


def spans_of(text: Column, k: int) -> Column:
    """The spans of one kind, in order, in time that grows with the text.

    What lies between the matches and the matches themselves are found each in
    one pass; places are running sums of their lengths.
    """
    kind, pattern, group, least = KINDS[k]
    pattern = SAME.get(kind, pattern)
    whole, value = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))

    def placed(m: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m))
        sizes = F.zip_with(between, m, lambda x, y: F.struct(F.length(x).cast("long").alias("b"), F.length(y).cast("long").alias("m")))

        def spans(n: Column) -> Column:
            at = before(F.transform(n, lambda x: x["b"] + x["m"]), lambda x, y: x + y, F.lit(0).cast("long"))
            return F.transform(F.arrays_zip(n.alias("n"), at.alias("at"), value.alias("v")), lambda x: _span(x["at"] + x["n"]["b"], x["n"]["m"], x["v"]))

        return let(sizes, spans)

    def _span(begin: Column, n: Column, v: Column) -> Column:
        return F.struct(begin.alias("start"), F.lit(k).alias("k"), F.lit(kind).alias("kind"), (begin + n).alias("end"), v.alias("value"))

    # a text without matches, which is nearly every one, is not split
    none = F.array().cast(f"array<{SPAN}>")
    return F.filter(let(whole, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(none)), lambda x: F.length(x["value"]) >= least)


def apart(own: Column, base: Column) -> Column:
    """The spans of `own` that overlap none of `base`.

    All are sorted by their starts; one overlaps an earlier span if the
    furthest end before it lies behind its start, and a later one if the
    nearest start after it lies before its end.
    """
    far = F.lit(2**62)

    def judged(spans: Column) -> Column:
        ends = before(F.transform(spans, lambda x: F.when(x["base"], x["s"]["end"]).otherwise(F.lit(-1).cast("long"))), F.greatest, F.lit(-1).cast("long"))
        starts = F.reverse(before(F.reverse(F.transform(spans, lambda x: F.when(x["base"], x["s"]["start"]).otherwise(far))), F.least, far))
        zipped = F.arrays_zip(spans.alias("x"), ends.alias("e"), starts.alias("n"))
        return F.transform(F.filter(zipped, lambda z: ~z["x"]["base"] & (z["e"] <= z["x"]["s"]["start"]) & (z["n"] >= z["x"]["s"]["end"])), lambda z: z["x"]["s"])

    tagged = lambda spans, is_base: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(is_base).alias("base"), x.alias("s")))
    both = F.array_sort(F.concat(tagged(own, False), tagged(base, True)))
    return F.when((F.size(own) > 0) & (F.size(base) > 0), let(both, judged)).otherwise(own)


def looks_live(value: Column) -> Column:
    """Random-looking: letters and digits mixed, at least eight different characters, and not marked as an example."""
    return (
        value.rlike("[0-9]")
        & value.rlike("[A-Za-z]")
        & (F.size(F.array_distinct(F.split(value, ""))) >= 8)
        & ~F.lower(value).rlike("example|changeme|placeholder|xxxx|1234567")
    )


def candidates(df: DataFrame, text: str, **more: Column) -> DataFrame:
    """carried(df) with `t` and `found`, the array of candidate spans by start, then kind.

    Positions count code points. Candidates of the kind "owned" are runs of
    twenty characters or more that look live, mix upper and lower case or hold
    four digits, and overlap no other span.
    """
    w = carried(df, t=F.coalesce(df[text], F.lit("")), **more)
    last = len(KINDS) - 1
    w = w.withColumns({f"s{k}": spans_of(F.col("t"), k) for k in range(len(KINDS))})
    mixed = lambda v: (v.rlike("[A-Z]") & v.rlike("[a-z]")) | v.rlike("[0-9].*[0-9].*[0-9].*[0-9]")
    w = w.withColumns({"base": F.concat(*[F.col(f"s{k}") for k in range(last)]), "own": F.filter(f"s{last}", lambda x: looks_live(x["value"]) & mixed(x["value"]))})
    return w.withColumn("found", F.array_sort(F.concat("base", apart(F.col("own"), F.col("base"))))).drop("base", "own", *[f"s{k}" for k in range(len(KINDS))])


def ownership(found: DataFrame) -> DataFrame:
    """value_id, n_rows, n_repositories, n_owners of each candidate value, over all rows of (value_id, repository, owner).

    Each step aggregates before its shuffle, so a value in a third of all rows
    is one row a task.
    """
    repositories = found.groupBy("value_id", "owner", "repository").agg(F.count("*").alias("rows"))
    owners = repositories.groupBy("value_id", "owner").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"))
    return owners.groupBy("value_id").agg(F.sum("rows").alias("n_rows"), F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def widely_copied(n_repositories: Column, n_owners: Column, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> Column:
    return (n_owners >= example_owners) | ((n_owners > 1) & (n_repositories >= example_repositories))


def scan(
    df: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id", example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES, redacted: bool = True
) -> DataFrame:
    """Adds spans and redacted to every row of df.

    spans: array of (start, k, kind, end, value, n_repositories, n_owners,
    live), ordered by start, then kind. Spans of the base kinds are all there;
    "owned" ones only where the value is live. live: it looks random and isn't
    widely_copied() in the whole corpus. redacted: the text with every live
    span replaced by [SECRET:kind]; with redacted=False, neither it nor the
    text is in the result, and no text is written.

    Null and empty texts have no spans. Null owners count as one owner, null
    repositories as one repository. The time for a text grows with its length
    and the number of its matches. Equal texts get equal results, so repeated
    rows do. Input columns named like an output are replaced. Only candidates
    meet their verdicts: those of values in HOT_ROWS rows or more, which are
    few for their rows, by broadcast, the others in a join on the value. With
    redacted=False values are null, and only their hashes are written.
    """
    kept = df if redacted else df.drop(text)
    w = candidates(df, text, owner=F.coalesce(df[owner].cast("string"), F.lit("")), repository=F.coalesce(df[repository].cast("string"), F.lit("")))
    if not redacted:
        w = w.withColumn("row", F.struct(F.lit(1).alias("__row"), *[F.col("row").getField(c).alias(c) for c in kept.columns]))

    def hashed(x):
        held = x["value"] if redacted else F.lit(None).cast("string")
        return F.struct(x["start"], x["k"], x["kind"], x["end"], held.alias("value"), F.sha2(x["value"], 256).alias("value_id"), looks_live(x["value"]).alias("live"))

    w = stage(w.withColumn("found", F.transform("found", hashed)).drop("t").withColumn("rid", F.monotonically_increasing_id()))
    some = w.where(F.size("found") > 0)
    found = some.select("rid", "owner", "repository", F.explode("found").alias("x")).select("rid", "owner", "repository", "x", F.col("x.value_id").alias("value_id"))
    held = stage(ownership(found.select("value_id", "owner", "repository")))
    hot = held.where(F.col("n_rows") >= HOT_ROWS)
    x = found.select("rid", "x", "value_id")
    known = x.join(held.where(F.col("n_rows") < HOT_ROWS), "value_id").unionByName(x.join(F.broadcast(hot), "value_id"))
    live = F.col("x.live") & ~widely_copied(F.col("n_repositories"), F.col("n_owners"), example_owners, example_repositories)
    judged = F.struct("x.start", "x.k", "x.kind", "x.end", "x.value", "n_repositories", "n_owners", live.alias("live"))
    verdicts = known.select("rid", judged.alias("x")).where((F.col("x.kind") != "owned") | F.col("x.live")).groupBy("rid").agg(F.array_sort(F.collect_list("x")).alias("spans"))
    j = w.select("rid", "row").join(verdicts, "rid", "left") if not redacted else some.select("rid", "row").join(verdicts, "rid", "left")
    spans = F.coalesce("spans", F.array().cast(verdicts.schema["spans"].dataType))
    if not redacted:
        return j.select(*[F.col("row").getField(c).alias(c) for c in kept.columns if c != "spans"], spans.alias("spans"))
    # rows without candidates, which carry their texts, meet no shuffle
    j = j.select("row", spans.alias("spans")).unionByName(w.where(F.size("found") == 0).select("row", F.array().cast(verdicts.schema["spans"].dataType).alias("spans")))
    j = j.withColumn("t", F.coalesce(F.col("row").getField(text), F.lit("")))

    def cut(chunked: Column, live: Column) -> Column:
        # overlapping spans: what an earlier one has covered is not written again
        at = before(F.transform(live, lambda x: x["end"]), F.greatest, F.lit(0).cast("long"))
        seen = F.filter(F.arrays_zip(live.alias("x"), at.alias("at")), lambda z: z["x"]["end"] > z["at"])
        pieces = F.transform(seen, lambda z: F.concat(part(chunked, z["at"], F.greatest(z["at"], z["x"]["start"])), F.lit("[SECRET:"), z["x"]["kind"], F.lit("]")))
        rest = part(chunked, F.array_max(F.transform(live, lambda x: x["end"])), F.length("t").cast("long"))
        return F.concat(F.array_join(pieces, ""), rest)

    whole = let(F.filter("spans", lambda x: x["live"]), lambda live: F.when(F.size(live) > 0, let(chunks(F.col("t")), lambda c: cut(c, live))).otherwise(F.col("t")))
    return restored(j.withColumn("redacted", whole), "spans", "redacted")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", n_chars: str | None = "n_chars", owner: str = "source", repository: str = "doc_id", **limits: int) -> DataFrame:
    """All rows of df, in its columns, with live secrets replaced in the text; null texts become empty."""
    others = [df[c] for c in df.columns if c != text]
    inner = df.select(F.struct(*others).alias("others"), df[text].alias("text"), df[owner].alias("owner"), df[repository].alias("repository"))
    scanned = scan(inner, "text", "owner", "repository", **limits)
    new = {text: F.col("redacted")}
    if n_chars and n_chars in df.columns:
        new[n_chars] = F.length("redacted").cast(df.schema[n_chars].dataType)
    return scanned.select(*[new.get(c, F.col("others").getField(c)).alias(c) for c in df.columns])
