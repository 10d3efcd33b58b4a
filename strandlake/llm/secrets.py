"""Secret scan by multipart credential linking, in DataFrame functions only.

Base findings are assignments (assign), access identifiers (access) and long hexadecimal runs (hex).
Each is a part of a credential: an access identifier or a secret. Weak candidates alone say little: a
login name (login), a keyed value or a long mixed token (weak), an address (endpoint). They are
reported only when complementary parts co-occur in their scope:

  login     needs a secret
  weak      needs an access identifier or an address (base assignments and hex runs count as secrets)
  endpoint  needs both an access identifier or login and a secret

A scope is a stanza (text between blank lines), and the gap between two parts is at most REACH code
points, however long the parts are. Of the parts that start no later than a candidate only the greatest
end can matter, and of those that start no earlier the least start; both are running aggregates by role
over the parts of the scope, so no pairs are formed, however many parts a text holds. Weak spans that
overlap a base span are not reported again; nor are weak spans that overlap an earlier weak one (login,
weak, endpoint at the same start).

Defined results: a null text counts as the empty text, without findings; repeated rows give repeated
results; a null id is kept; rows that share an id but not a text are scanned apart; tokens and texts of any
length are scanned whole; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .spans import KEY, keyed, matches, same_text

#: Code points between two parts that are linked.
REACH = 400

#: The base patterns, in the order of their kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

LOGIN = r"""(?i:\b(?:user(?:_?name)?|login|account(?:_?id)?|client_?id|access_?(?:key_?)?id)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9@._-]{3,})"""
WEAK = r"""(?i:\b(?:pass|pwd|key|auth|credential|signature|private_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]{6,})"""
#: A run of token letters; one that lacks a digit, a capital or a small letter is none.
TOKEN = r"""(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}"""
ENDPOINT = r"""(?i:\b(?:https?|jdbc|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)(?::[a-z0-9]+)?://[^\s"'<>]+|\b(?:host|server|endpoint)["']?\x20*[:=]\x20*["']?[a-z0-9.:-]{4,})"""
STANZA = r"\n[\x20\t\r]*\n"

BASE_KINDS = ("assign", "access", "hex")
WEAK_KINDS = ("login", "weak", "endpoint")
KINDS = (*BASE_KINDS, *WEAK_KINDS)


def kind_order(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def _base(texts: DataFrame) -> DataFrame:
    body = F.col("sp_text")
    found = matches(
        texts,
        {"assign": (ASSIGN, 2), "access": (ACCESS, 0), "hex": (HEX, 0)},
        {"access": body.contains("AKIA"), "assign": body.rlike("[:=]")},
    )
    return found.where((F.col("kind") != "assign") | (F.length("found") >= 6)).select(*KEY, "kind", "start", "end")


def _weak(texts: DataFrame) -> DataFrame:
    body = F.col("sp_text")
    keyed_value, address = body.rlike("[:=]"), body.contains("://") | body.rlike(r"(?i)(?:host|server|endpoint)[\"']?\x20*[:=]")
    token = body.rlike("[A-Za-z0-9+/_-]{32}")
    both = texts.where(keyed_value | address | token)
    found = matches(both, {"login": (LOGIN, 0), "weak": (WEAK, 0), "token": (TOKEN, 0), "endpoint": (ENDPOINT, 0), "stanza": (STANZA, 0)}, {"login": keyed_value, "weak": keyed_value, "token": token, "endpoint": address})
    mixed = F.col("found").rlike("[0-9]") & F.col("found").rlike("[A-Z]") & F.col("found").rlike("[a-z]")
    return found.where((F.col("kind") != "token") | mixed).select(*KEY, F.when(F.col("kind") == "token", "weak").otherwise(F.col("kind")).alias("kind"), "start", "end")


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak rows of `parts` (KEY, scope, kind, start, end) whose complementary parts are in reach in their scope."""
    role = F.when(F.col("kind").isin("access", "login"), "id").when(F.col("kind") == "endpoint", "at").otherwise("secret")
    parts = parts.withColumn("role", role)
    scope = Window.partitionBy(*KEY, "scope")
    # What starts no later and what starts no earlier. No part has the role that its own kind needs.
    before, after = (scope.orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.col("start"), F.col("start").desc()))

    def near(r: str) -> Column:
        last = F.max(F.when(F.col("role") == r, F.col("end"))).over(before)
        first = F.min(F.when(F.col("role") == r, F.col("start"))).over(after)
        return F.coalesce(F.col("start") - last <= reach, F.lit(False)) | F.coalesce(first - F.col("end") <= reach, F.lit(False))

    met = parts.select(*KEY, "kind", "start", "end", *[near(r).alias(f"near_{r}") for r in ("id", "secret", "at")]).where(F.col("kind").isin(*WEAK_KINDS))
    kept = F.when(F.col("kind") == "login", F.col("near_secret")).when(F.col("kind") == "weak", F.col("near_id") | F.col("near_at")).otherwise(F.col("near_id") & F.col("near_secret"))
    return met.where(kept).select(*KEY, "kind", "start", "end")


def findings(docs: DataFrame, *, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """One row for each finding: sp_id (the id), sp_hash (XXH64 of the text), kind, start, end, base."""
    texts = keyed(docs, key, text)
    # Places only, no texts: the patterns run once, and what follows reads the written rows.
    events = cut(_base(texts).union(_weak(texts)))
    base = events.where(F.col("kind").isin(*BASE_KINDS))
    by_text = Window.partitionBy(*KEY).orderBy("start", "end", kind_order(F.col("kind")))
    upto = by_text.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*KEY).orderBy(F.col("start").desc(), F.col("end").desc(), kind_order(F.col("kind")).desc()).rowsBetween(Window.unboundedPreceding, -1)
    is_base, is_weak = F.col("kind").isin(*BASE_KINDS), F.col("kind").isin(*WEAK_KINDS)
    # A text that is a third of all parts is one window group, which Spark sorts and streams with spilling.
    scoped = events.withColumn("scope", F.count(F.when(F.col("kind") == "stanza", 1)).over(by_text.rowsBetween(Window.unboundedPreceding, 0)))
    scoped = scoped.withColumn("base_end", F.max(F.when(is_base, F.col("end"))).over(upto)).withColumn("base_start", F.min(F.when(is_base, F.col("start"))).over(after))
    clear = ~(F.coalesce(F.col("base_end") > F.col("start"), F.lit(False)) | F.coalesce(F.col("base_start") < F.col("end"), F.lit(False)))
    parts = scoped.where(is_base | (is_weak & clear)).select(*KEY, "scope", "kind", "start", "end")
    reported = linked(parts, reach)
    first = reported.withColumn("before", F.max("end").over(upto)).where("before is null or before <= start").select(*KEY, "kind", "start", "end")
    return base.withColumn("base", F.lit(True)).union(first.withColumn("base", F.lit(False)))


def listed(found: DataFrame) -> DataFrame:
    """One row a text with findings: KEY and spans, an ordered array of (start, order, kind, end, base)."""
    row = F.struct("start", kind_order(F.col("kind")).alias("order"), "kind", "end", "base")
    return found.groupBy(*KEY).agg(F.array_sort(F.collect_list(row)).alias("spans"))


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """Column `key` and spans of every row, in which a text without findings has an empty array."""
    spans = listed(findings(docs, key=key, text=text, reach=reach))
    rows = docs.select(docs[key].alias("sp_id"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("sp_hash"))
    joined = rows.join(spans, same_text(rows, spans), "left")
    empty = F.expr("cast(array() as array<struct<start:bigint,order:bigint,kind:string,end:bigint,base:boolean>>)")
    return joined.select(rows["sp_id"].alias(key), F.coalesce(F.col("spans"), empty).alias("spans"))


def redacted(docs: DataFrame, *, key: str = "doc_id", text: str = "text", mark: str = "[secret]", reach: int = REACH) -> DataFrame:
    """The rows of docs, all columns, with every finding in the text replaced by `mark`; overlapping findings get one mark."""
    spans = listed(findings(docs, key=key, text=text, reach=reach)).select(F.col("sp_id").alias("__id"), F.col("sp_hash").alias("__hash"), F.col("spans").alias("__spans"))
    rows = docs.withColumn("__row", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    joined = rows.join(spans, F.col(key).eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__hash")), "left")

    def step(done: Column, span: Column) -> Column:
        # What lies between the findings so far and this one, and its mark if it begins after them.
        gap = F.when(span["start"] >= done["at"], F.concat(F.substring(F.col(text), done["at"].cast("int") + 1, (span["start"] - done["at"]).cast("int")), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(done["at"], span["end"]).alias("at"), F.array_append(done["parts"], gap).alias("parts"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))
    end = F.aggregate("__spans", start, step)
    rest = F.substring(F.col(text), end["at"].cast("int") + 1, F.length(text))
    return joined.withColumn(text, F.when(F.col("__spans").isNull(), F.col(text)).otherwise(F.concat(F.array_join(end["parts"], ""), rest))).select(*docs.columns)
