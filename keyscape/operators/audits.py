"""Audits of text evidence: credentials, citations, links, claim ledgers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What must never stand in published evidence.
CREDENTIAL_PATTERNS = {
    "credential-shaped value": (
        r"AKIA[A-Z0-9]{16}|ASIA[A-Z0-9]{16}|(?i:X-Amz-Signature=[A-Fa-f0-9]{16,}|X-Amz-Credential=[A-Za-z0-9%/+-]{10,}"
        r"|X-Amz-Security-Token=[A-Za-z0-9%/+=]{20,}|(AWS_SESSION_TOKEN|AWS_SECRET_ACCESS_KEY)=[A-Za-z0-9/+=]{16,}"
        r"|aws_secret_access_key[ \t\n\r\f\v]*=[ \t\n\r\f\v]*[A-Za-z0-9/+=]{20,}|Authorization:[ \t\n\r\f\v]*(AWS4-HMAC-SHA256|Bearer|Basic)[ \t\n\r\f\v])"
    ),
    "GCP private key": r"BEGIN PRIVATE KEY",
}


def credential_scan(df: DataFrame, id_col: str, text_col: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """(id, patterns): rows whose text some pattern matches, and the patterns' names."""
    names = [F.when(F.col(text_col).rlike(p), F.lit(n)) for n, p in (patterns or CREDENTIAL_PATTERNS).items()]
    return df.select(F.col(id_col), F.array_compact(F.array(*names)).alias("patterns")).filter(F.size("patterns") > 0)


#: How a citation is written. A label opens with this marker and a blank and ends at the next bracket; its commit
#: stands behind its last @; its parts are parted by semicolons, a part's lines from its path by a colon.
_OPENS = r"\[SRC(?=\s)"
_COMMIT = r"\A[0-9a-f]{7,40}\z"
_LINES = r"\A[0-9]+(-[0-9]+)?\z"
_BLANKS = " \t\n\r\f\x0b"


def _newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def _bare(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def _are_lines(spec: Column) -> Column:
    """Whether all that commas part are numbers or ranges."""
    return F.forall(F.split(spec, ",", -1), lambda x: x.rlike(_LINES))


def citations(pages: DataFrame) -> DataFrame:
    """(page, line, commit, path, lines, parsed) of each part of each source label of pages(page, text).

    A label without a commit takes the page's, if all of its others agree; a part
    that can't be read, or has no commit, is returned with parsed false.
    """
    # the first piece stands before all labels, each other one begins behind a label's marker
    pieces = pages.select("page", F.posexplode(F.split("text", _OPENS, -1)).alias("at", "piece"))
    above = F.sum(_newlines(F.col("piece"))).over(W.partitionBy("page").orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    labels = pieces.withColumn("line", above + 1).filter((F.col("at") > 0) & F.col("piece").contains("]"))
    body = F.substring_index("piece", "]", 1)
    tail = _bare(F.substring_index(body, "@", -1))
    own = F.when(body.contains("@") & tail.rlike(_COMMIT), tail)
    rest = F.when(own.isNotNull(), F.reverse(F.substring(F.reverse(body), F.length(F.substring_index(body, "@", -1)) + 2, F.length(body)))).otherwise(body)
    labels = labels.select("page", "line", own.alias("own"), rest.alias("rest"))
    page = W.partitionBy("page")
    only = F.when(F.min("own").over(page) == F.max("own").over(page), F.min("own").over(page))
    labels = labels.withColumn("commit", F.coalesce("own", only))
    parts = labels.select("page", "line", "commit", F.explode(F.when(F.col("commit").isNull(), F.array("rest")).otherwise(F.split("rest", ";", -1))).alias("part"))
    parts = parts.withColumn("part", _bare(F.rtrim(_bare(F.col("part")), F.lit(",")))).filter("part <> ''")
    path = F.substring_index("part", ":", 1)
    lines = F.when(F.col("part").contains(":"), F.translate(F.substring("part", F.length(path) + 2, F.length("part")), _BLANKS, ""))
    good = F.col("commit").isNotNull() & (path != "") & ~path.rlike(r"\s") & (lines.isNull() | _are_lines(lines))
    return parts.select("page", F.col("line").cast("long").alias("line"), "commit", F.when(good, path).alias("path"), F.when(good, lines).alias("lines"), good.alias("parsed"))


def parse_ranges(spec: Column) -> Column:
    """`a-b,c` as array<struct<first, last>>; NULL for another shape."""
    one = lambda p: F.struct(F.substring_index(p, "-", 1).cast("bigint").alias("first"), F.substring_index(p, "-", -1).cast("bigint").alias("last"))
    return F.when(_are_lines(spec), F.transform(F.split(spec, ","), one))


def line_count(content: Column) -> Column:
    """Lines of a file; a last one without a line feed counts."""
    return (_newlines(content) + F.when((content != "") & ~content.endswith("\n"), 1).otherwise(0)).cast("long")


def check_citations(cites: DataFrame, files: DataFrame) -> DataFrame:
    """T4: cites(commit, path, lines, ...) with `problem`, from files(commit, path, content).

    The first bad range decides: `line 0`, `inverted` or `past end`; `missing file` comes
    before them, and a malformed specification is `unparseable`.
    """
    held = files.select("commit", "path", line_count(F.col("content")).alias("n_lines"))
    ranges = parse_ranges(F.col("lines"))
    bad = lambda r: F.when(r["first"] < 1, "line 0").when(r["last"] < r["first"], "inverted").when(r["last"] > F.col("n_lines"), "past end")
    first = F.get(F.array_compact(F.transform(ranges, bad)), F.lit(0))
    problem = F.when(F.col("n_lines").isNull(), "missing file").when(F.col("lines").isNotNull(), F.when(ranges.isNull(), "unparseable").otherwise(first))
    return cites.join(held, ["commit", "path"], "left").withColumn("problem", problem).drop("n_lines")


def citation_tally(cites: DataFrame, roots: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """T5: (repository, commit, status, n) over cites(repository, commit, path) and roots(repository, revision).

    `checked` where the root is at the cited commit, `unresolved` where it is but files(repository,
    path) of the roots lack the path, `refused` where it is elsewhere, `skipped` without a
    root; roots that no citation uses are `unused` with n 0.
    """
    r = roots.select(F.col("repository").alias("root"), "revision")
    joined = cites.join(r, F.col("repository") == F.col("root"), "left").withColumn("held", F.lit(True))
    if files is not None:
        held = files.select("repository", "path").distinct().withColumn("_there", F.lit(True))
        joined = joined.drop("held").join(held, ["repository", "path"], "left").withColumn("held", F.col("_there").isNotNull())
    at_commit = F.when(F.col("held"), "checked").otherwise("unresolved")
    status = F.when(F.col("root").isNull(), "skipped").when(F.col("revision").startswith(F.col("commit")), at_commit).otherwise("refused")
    used = joined.groupBy("repository", "commit", status.alias("status")).agg(F.count("*").alias("n"))
    unused = roots.join(cites.select("repository"), "repository", "left_anti").select("repository", F.col("revision").alias("commit"), F.lit("unused").alias("status"), F.lit(0).cast("long").alias("n"))
    return used.unionByName(unused)


def links(pages: DataFrame) -> DataFrame:
    """(page, target) of the relative links of pages(page, text).

    What `](` parts are pieces: a link's text ends one, behind its last closing bracket, and its target begins the next.
    """
    p = F.split("text", r"\]\(", -1)
    both = F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: F.struct(F.substring_index(a, "]", -1).alias("before"), b.alias("behind")))
    rows = pages.select("page", F.explode(both).alias("l")).filter(F.col("l.before").contains("[") & F.col("l.behind").contains(")"))
    inside = F.substring_index("l.behind", ")", 1)
    target = F.get(F.split(inside, r"\s"), F.lit(0))
    title = _bare(F.substring(inside, F.length(target) + 1, F.length(inside)))
    rows = rows.select("page", target.alias("target"), title.alias("title")).filter((F.col("target") != "") & ((F.col("title") == "") | F.left("title", F.lit(1)).isin("'", '"')))
    away = reduce(Column.__or__, [F.col("target").startswith(x) for x in ("http://", "https://", "mailto:")])
    return rows.filter(~away).select("page", "target")


#: What a slug keeps are word characters, hyphens and blanks, which become hyphens; marks of emphasis go first.
_NO_SLUG, _EMPHASIS = r"(?U)[^\w\- ]", "`*~"


def heading_ids(pages: DataFrame) -> DataFrame:
    """(page, id): heading slugs, numbered from their second use on a page on, and explicit anchors."""
    lines = pages.select("page", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).filter(F.col("line").rlike(r"\A#{1,6}\s"))
    head = _bare(F.rtrim(_bare(F.ltrim("line", F.lit("#"))), F.lit("#")))
    slug = F.regexp_replace(F.lower(_bare(F.translate(head, _EMPHASIS, ""))), _NO_SLUG, "")
    rows = lines.filter(head != "").select("page", "at", F.btrim(F.translate(slug, " ", "-"), F.lit("-")).alias("slug"))
    n = F.row_number().over(W.partitionBy("page", "slug").orderBy("at")) - 1
    rows = rows.withColumn("n", n).select("page", F.when(F.col("n") == 0, F.col("slug")).otherwise(F.concat_ws("-", "slug", "n")).alias("id"))
    # an anchor's piece begins with its quoted name
    tags = pages.select("page", F.explode(F.split("text", r"(?i)<a\s+(?:name|id)=", -1)).alias("piece"))
    quoted = tags.filter(F.left("piece", F.lit(1)).isin("'", '"')).select("page", F.get(F.split(F.substring("piece", F.lit(2), F.length("piece")), "[\"']", -1), F.lit(0)).alias("id"))
    return rows.unionByName(quoted.filter("id <> ''")).distinct()


def resolve(page: Column, path: Column) -> Column:
    """`path` relative to the folder of `page`, with . and .. taken out."""
    full = F.concat(F.regexp_extract(page, r"(?s)\A(.*/)?", 0), path)
    step = lambda acc, s: F.when((s == "") | (s == "."), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(F.split(full, "/", -1), F.array().cast("array<string>"), step), "/")


def _folders(paths: DataFrame) -> DataFrame:
    """(path) of all folders above paths(path); the root is empty."""
    steps = F.split("path", "/", -1)
    return paths.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))).alias("path")).distinct()


def link_integrity(found: DataFrame, pages: DataFrame, ids: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(page, target, problem) of links whose file, Markdown page or fragment is missing.

    found: page, target; pages: page; ids: page, id; files: further files (path). A folder is there if a file is
    below it; a fragment of a folder is looked for in its README.md.
    """
    path, fragment = F.split_part("target", F.lit("#"), F.lit(1)), F.nullif(F.regexp_replace("target", r"\A[^#]*#?", ""), F.lit(""))
    rows = found.select("page", "target", F.when(path == "", F.col("page")).otherwise(resolve(F.col("page"), path)).alias("to"), fragment.alias("fragment"))
    held = pages.select(F.col("page").alias("path"))
    held = (held if files is None else held.unionByName(files.select("path"))).distinct()
    places = held.withColumn("folder", F.lit(False)).unionByName(_folders(held).join(held, "path", "left_anti").withColumn("folder", F.lit(True)))
    rows = rows.join(places.withColumnRenamed("path", "to"), "to", "left")
    rows = rows.withColumn("file", F.when(F.col("folder"), F.concat_ws("/", F.nullif("to", F.lit("")), F.lit("README.md"))).otherwise(F.col("to")))
    rows = rows.join(held.select(F.col("path").alias("file"), F.lit(True).alias("is_file")), "file", "left")
    rows = rows.join(ids.select(F.col("page").alias("file"), F.col("id").alias("fragment")).distinct().withColumn("known", F.lit(True)), ["file", "fragment"], "left")
    no_page = ~F.lower("file").endswith(".md") | F.col("is_file").isNull()
    problem = F.when(F.col("folder").isNull(), "missing target").when(F.col("fragment").isNotNull(), F.when(no_page, "fragment target is not Markdown").when(F.col("known").isNull(), "missing fragment"))
    return rows.select("page", "target", problem.alias("problem")).filter("problem is not null")


#: Kinds of evidence that a settled claim may rest on.
SETTLED_KINDS = ("source", "documentation", "run", "observation")


def claim_rules(claims: DataFrame) -> DataFrame:
    """(tool, id, problem) of claims(tool, id, status, evidence array<struct<kind, reason>>) that break a status rule."""
    e = F.col("evidence")
    settled = F.forall(e, lambda x: F.coalesce(x["kind"].isin(*SETTLED_KINDS), F.lit(False)))
    run = F.exists(e, lambda x: F.coalesce(x["kind"] == "run", F.lit(False)))
    nothing = F.forall(e, lambda x: F.coalesce(x["kind"] == "none", F.lit(False)) & x["reason"].isNotNull())
    problem = (
        F.when(F.col("status").isin("confirmed", "supported") & ~settled, "kind")
        .when((F.col("status") == "confirmed") & ~run, "no run")
        .when(F.col("status").isin("unverified", "unverifiable") & ~nothing, "evidence of an unverified claim")
    )
    return claims.select("tool", "id", problem.alias("problem")).filter("problem is not null")


def duplicate_claims(claims: DataFrame) -> DataFrame:
    """Claim ids that a tool holds several times."""
    return claims.groupBy("tool", "id").agg(F.count("*").alias("n")).filter("n > 1")


def missing_evidence(evidence: DataFrame, inventory: DataFrame) -> DataFrame:
    """(tool, claim_id, field, path) of evidence's receipts, artifacts and documentation paths not in inventory(tool, path)."""
    named = F.array(
        F.struct(F.lit("receipt").alias("field"), F.col("receipt").alias("path")), F.struct(F.lit("artifact").alias("field"), F.col("artifact").alias("path")),
        F.struct(F.lit("documentation").alias("field"), F.when(F.col("kind") == "documentation", F.col("path")).alias("path")),
    )
    rows = evidence.select("tool", "claim_id", F.explode(named).alias("n")).select("tool", "claim_id", "n.field", "n.path").filter("path <> ''")
    return rows.join(inventory.select("tool", "path"), ["tool", "path"], "left_anti").select("tool", "claim_id", "field", "path")


def provenance(evidence: DataFrame, tools: DataFrame) -> DataFrame:
    """(tool, claim_id, problem) of source evidence that disagrees with tools(tool, tested_repository, tested_revision, upstream_repository)."""
    rows = evidence.filter("kind = 'source'").join(tools, "tool")
    tested = F.col("subject") == "tested-variant"
    wrong = F.array(
        F.when(tested & ~F.col("repository").eqNullSafe(F.col("tested_repository")), "tested repository"),
        F.when(tested & (F.coalesce("tested_revision", F.lit("")) != "") & ~F.col("tested_revision").startswith(F.coalesce("commit", F.lit(""))), "tested commit"),
        F.when((F.col("subject") == "upstream") & ~F.col("repository").eqNullSafe(F.col("upstream_repository")), "upstream repository"),
    )
    return rows.select("tool", "claim_id", F.explode(F.array_compact(wrong)).alias("problem"))


def origin_conservation(expected: DataFrame, claims: DataFrame, mapping: DataFrame) -> DataFrame:
    """(tool, origin, problem) over expected(tool, origin), claims(tool, id, origin) and mapping(tool, origin, entry, id).

    `missing` of the claims, `unexpected` in them, `unmapped` or `mapped but unexpected` in
    the mapping, `mapped twice` where several of its entries hold an origin, `unknown claim`
    where it names an id that the tool doesn't have, and `mapping disagrees` where its ids aren't the claims'.
    """
    e = expected.select("tool", "origin").distinct().withColumn("e", F.lit(True))
    c = claims.groupBy("tool", "origin").agg(F.array_sort(F.collect_set("id")).alias("c"))
    known = claims.select("tool", "id").distinct().withColumn("known", F.lit(True))
    m = mapping.join(known, ["tool", "id"], "left").groupBy("tool", "origin").agg(
        F.array_sort(F.collect_set("id")).alias("m"), (F.min("entry") < F.max("entry")).alias("twice"), F.bool_or(F.col("known").isNull() & F.col("id").isNotNull()).alias("stray")
    )
    all_ = e.join(c, ["tool", "origin"], "full_outer").join(m, ["tool", "origin"], "full_outer")
    problems = F.array(
        F.when(F.col("e").isNotNull() & F.col("c").isNull(), "missing"), F.when(F.col("e").isNull() & F.col("c").isNotNull(), "unexpected"),
        F.when(F.col("e").isNotNull() & F.col("m").isNull(), "unmapped"), F.when(F.col("e").isNull() & F.col("m").isNotNull(), "mapped but unexpected"),
        F.when(F.col("twice"), "mapped twice"), F.when(F.col("stray"), "unknown claim"),
        F.when(F.col("m").isNotNull() & ~F.col("m").eqNullSafe(F.coalesce("c", F.array().cast("array<string>"))), "mapping disagrees"),
    )
    return all_.select("tool", "origin", F.explode(F.array_compact(problems)).alias("problem"))
