"""Scalar functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import checkpoint_dir

#: Dimensions of the hash embedding.
EMBED_DIM = 256

# Ordered keyword classes, first match wins.
VULNERABILITY = [
    ("ldap", ["ldap", "ldap-injection"]),
    ("xss", ["xss", "cross-site", "html", "nickname", "renderprofile"]),
    ("sqli", ["sqli", "sql injection", "jdbc-sqli", "formatted-sql", "second-order"]),
    ("path_traversal", ["path traversal", "path-traversal", "aid-java-path-traversal"]),
    ("command_injection", ["command injection", "runtime.exec", "processbuilder"]),
    ("xxe", ["xxe", "documentbuilder", "doctype"]),
    ("deserial", ["deserial", "objectinputstream"]),
    ("crypto_weak", ["md5", "ecb", "cipher", "padding-oracle", "weak hash", "aes/"]),
    ("tls", ["ssl", "tls", "trust-manager", "hostname-verifier", "weak-ssl"]),
    ("secret", ["secret", "jwt", "gitleaks", "private-key", "password", "token", "api_key"]),
    ("ssrf", ["ssrf", "webhook", "callbackurl", "callback"]),
    ("resource_leak", ["resource leak", "resource_leak", "not closed", "try-with-resources"]),
    ("redirect", ["open redirect", "redirect"]),
    ("redos", ["redos", "backtracking", "(a+)+"]),
]


def hash_embedding(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Sparse unit vectors (keys, idx, value): signed hashed counts of tokens and their trigrams.

    Counted per distinct gram before hashing, so a gram is hashed once a text.
    """
    tokens = df.select(*keys, F.explode(F.expr(f"regexp_extract_all(lower(coalesce(`{text}`, '')), '[a-z0-9_]+', 0)")).alias("t"))
    trigrams = F.when(F.length("t") >= 3, F.expr("transform(sequence(1, length(t) - 2), i -> substr(t, i, 3))")).otherwise(F.array().cast("array<string>"))
    grams = tokens.select(*keys, F.explode(F.concat(F.array("t"), trigrams)).alias("g")).groupBy(*keys, "g").count()
    digest = grams.withColumn("h", F.md5(F.col("g").cast("binary")))
    signed = digest.select(*keys, F.conv(F.substring("h", 31, 2), 16, 10).cast("int").alias("idx"), (F.when(F.conv(F.substring("h", 30, 1), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1) * F.col("count")).alias("n"))
    cells = signed.groupBy(*keys, "idx").agg(F.sum("n").cast("double").alias("n")).where("n <> 0")
    norms = cells.groupBy(*keys).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return cells.join(norms, keys).select(*keys, "idx", (F.col("n") / F.col("norm")).alias("value"))


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def tokens(c: Column) -> Column:
    """Distinct lower-case alphanumeric tokens longer than one character."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0), lambda t: F.length(t) > 1))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common tokens; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def dice(common: Column, n1: Column, n2: Column) -> Column:
    """2 common / (n1 + n2): 1 where both are empty, 0 where one is."""
    return F.when((n1 == 0) & (n2 == 0), F.lit(1.0)).otherwise(2.0 * common / (n1 + n2))


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / 4)).cast("long")


def canonical_url(c: Column) -> Column:
    """Without the fragment."""
    return F.regexp_replace(c, "#.*$", "")


def slug(c: Column, most: int = 80) -> Column:
    cleaned = F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9._-]+", "-")
    return F.substring(F.regexp_replace(cleaned, "^-+|-+$", ""), 1, most)


def first_match(c: Column, classes: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """The first class any of whose keywords the text contains; one quoted alternation a class."""
    out = F.lit(otherwise)
    for name, words in reversed(classes):
        out = F.when(c.rlike("|".join(f"\\Q{w}\\E" for w in words)), F.lit(name)).otherwise(out)
    return out


def first_rule(c: Column, rules: list[tuple[str, str]], otherwise: str | None) -> Column:
    """The first rule whose regular expression matches."""
    out = F.lit(otherwise)
    for name, pattern in reversed(rules):
        out = F.when(c.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def squash(c: Column) -> Column:
    return F.regexp_replace(c, "\\s+", "")


def prose_lines(c: Column) -> Column:
    """Line numbers named in prose: 'line 4', 'lines 3-6', 'L12', in ascending order."""
    spans = F.regexp_extract_all(c, F.lit("(?i)\\b(?:lines?|L)\\s*(\\d+(?:\\s*[-,]\\s*\\d+)*)"), 1)
    parts = F.flatten(F.transform(spans, lambda s: F.split(s, "\\s*,\\s*")))

    def numbers(part):
        ends = F.transform(F.split(part, "\\s*-\\s*"), lambda x: F.trim(x).cast("int"))
        low, high = F.element_at(ends, 1), F.element_at(ends, -1)
        return F.when(high - low <= 5000, F.sequence(F.least(low, high), F.greatest(low, high))).otherwise(F.array(low, high))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, numbers))))


def added_lines(c: Column) -> Column:
    """Line numbers that the hunk headers of a unified diff cover on the new side."""
    heads = F.regexp_extract_all(c, F.lit("@@ -\\d+(?:,\\d+)? \\+(\\d+(?:,\\d+)?) @@"), 1)

    def span(head):
        parts = F.split(head, ",")
        start = F.element_at(parts, 1).cast("int")
        count = F.when(F.size(parts) > 1, F.element_at(parts, -1).cast("int")).otherwise(F.lit(1))
        return F.when(count > 0, F.sequence(start, start + count - 1)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(heads, span))


def expand(c: Column, values: Column) -> Column:
    """${NAME} replaced from a map; unknown names stay."""
    return F.aggregate(F.map_entries(values), c, lambda s, e: F.replace(s, F.concat(F.lit("${"), e["key"], F.lit("}")), e["value"]))


def duration_text(ms: Column) -> Column:
    """Rounded down: '850 ms', '12.3 s' or '2 min 5 s'."""
    s = ms / 1000.0
    minutes = F.floor(s / 60)
    return F.when(ms < 1000, F.format_string("%d ms", ms.cast("long"))).when(s < 60, F.format_string("%.1f s", F.floor(ms / 100) / 10)).otherwise(F.format_string("%d min %d s", minutes.cast("long"), F.floor(s - minutes * 60).cast("long")))


def json_in_prose(c: Column) -> Column:
    """The first fenced or else the outermost braced JSON object of a text."""
    fenced = F.regexp_extract(c, "(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```", 1)
    braced = F.regexp_extract(c, "(?s)(\\{.*\\})", 1)
    return F.nullif(F.when(fenced != "", fenced).otherwise(braced), F.lit(""))


def clip(c: Column, most: int) -> Column:
    """At most ``most`` characters, never cutting inside an identifier, with an ellipsis when cut."""
    # \z and not $, which also stands before a newline at the end
    cut = F.regexp_replace(F.substring(c, 1, most), r"[A-Za-z0-9_]+\z", "")
    whole = F.substring(c, 1, most)
    inside = F.substring(c, most + 1, 1).rlike("[A-Za-z0-9_]") & whole.rlike(r"[A-Za-z0-9_]\z")
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.rtrim(F.when(inside & (F.length(cut) > 0), cut).otherwise(whole)), F.lit("…")))


def round_half_up(c: Column, digits: int) -> Column:
    return F.round(c, digits)


def recent(ts: Column, as_of: str, days: int) -> Column:
    """Within some days before a given instant; the instant is injected, never 'now'."""
    at = F.lit(as_of).cast("timestamp_ntz")
    return (ts >= at - F.expr(f"INTERVAL {days} DAYS")) & (ts <= at)


def model_tier(severity: Column, category: Column) -> Column:
    """Which model tier judges a finding: severity forces, then the category decides."""
    return F.when(severity.isin("P0", "P1"), "deep").when(category.isin("security", "secret", "concurrency", "auth"), "deep").when(category.isin("hygiene", "style"), "light").otherwise("standard")


def flatten_json(df: DataFrame, keys: list[str], json: str, max_rounds: int = 1000) -> DataFrame:
    """(keys, path, value) of the scalar leaves of a JSON text, as dotted paths with [i] for items.

    One checkpointed round per level, until no level is left; raises after ``max_rounds``.
    """
    checkpoint_dir(df.sparkSession)
    level = df.select(*keys, F.lit("").alias("path"), F.col(json).alias("node"))
    leaves = None
    for _ in range(max_rounds):
        shape = F.substring(F.ltrim("node"), 1, 1)
        # a string that only looks like JSON is a leaf
        nested = F.when(shape == "{", F.from_json("node", "map<string,string>").isNotNull()).when(shape == "[", F.from_json("node", "array<string>").isNotNull()).otherwise(False)
        inner = level.where(nested)
        scalar = level.where(~nested).select(*keys, "path", F.col("node").alias("value"))
        leaves = scalar if leaves is None else leaves.unionByName(scalar)
        fields = inner.where(F.substring(F.ltrim("node"), 1, 1) == "{").select(*keys, "path", F.explode(F.from_json("node", "map<string,string>")).alias("__k", "__v"))
        fields = fields.select(*keys, F.when(F.col("path") == "", F.col("__k")).otherwise(F.concat_ws(".", "path", "__k")).alias("path"), F.col("__v").alias("node"))
        items = inner.where(F.substring(F.ltrim("node"), 1, 1) == "[").select(*keys, "path", F.posexplode(F.from_json("node", "array<string>")).alias("__i", "__v"))
        items = items.select(*keys, F.format_string("%s[%d]", "path", "__i").alias("path"), F.col("__v").alias("node"))
        level = fields.unionByName(items).checkpoint()
        if level.isEmpty():
            break
    else:
        raise RuntimeError("JSON levels did not settle")
    return leaves.where("value is not null")
