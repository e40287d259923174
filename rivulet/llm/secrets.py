"""Secret scan with multipart credential linking; DataFrame functions only.

Base kinds, each found leftmost and non-overlapping over the whole text:

* ``assign``: a password, secret, token or API key given a value of 6 or more;
* ``access``: an access identifier of 20 or more characters;
* ``hex``: 24 or more hexadecimal digits.

Weak kinds, which alone say little and are reported only with their
complement in scope (``scope`` code points between the two spans at most):

* ``opaque`` (a mixed run of 20 or more): with an identifier or an endpoint;
* ``user`` (a user, login, account or client id): with a secret;
* ``endpoint`` (a connection URL): with a secret and with an identifier.

Secrets are assign, hex and opaque; identifiers are access and user.  Scopes
are intervals: weak spans and all spans are put into cells of ``scope`` code
points of their document and joined there.  Spans of a kind do not overlap, so
a cell holds a bounded number of them, however long the text is.

Defined results: a null text counts as empty and has no spans; rows with equal
ids and texts have equal spans each; null ids are carried.  Positions are code
points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
USER = r"""(?i)(?<![A-Za-z0-9_])(?:user(?:_?name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}"""
ENDPOINT = r"""(?i)(?<![A-Za-z0-9_])(?:https?|ftp|sftp|ssh|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+"""
OPAQUE = r"[A-Za-z0-9+/]{20,}"

KINDS = ("assign", "access", "hex", "opaque", "user", "endpoint")
_BASE = KINDS[:3]
_SECRET, _IDENTIFIER = ("assign", "hex", "opaque"), ("access", "user")
_CUT, _INSTEAD = "\u0001", "\u0002"
_SPANS = "array<struct<s:int,e:int>>"


def _spans(text: Column, quick: str, pattern: str, keep) -> Column:  # noqa: ANN001
    """array<struct<s, e>> of the matches that ``keep``.

    Matches are fenced by a character that no pattern takes, the text is split
    there, and the pieces' lengths give the places.
    """
    pieces = F.split(F.regexp_replace(text, pattern, f"{_CUT}$0{_CUT}"), _CUT, -1)
    none = F.array().cast(_SPANS)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), none.alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        one = F.array(F.struct(acc["at"].alias("s"), end.alias("e")))
        out = F.when(acc["hit"] & keep(piece), F.concat(acc["out"], one)).otherwise(acc["out"])
        return F.struct(end.alias("at"), (~acc["hit"]).alias("hit"), out.alias("out"))

    return F.when(text.rlike(quick), F.aggregate(pieces, start, step, lambda acc: acc["out"])).otherwise(none)


def scan(text: Column) -> dict[str, Column]:
    """Spans of each kind of ``KINDS`` in a text column, linked or not."""
    t = F.translate(F.coalesce(text, F.lit("")), _CUT, _INSTEAD)
    all_kinds = lambda p: p.rlike("[a-z]") & p.rlike("[A-Z]") & p.rlike("[0-9]")
    yes = lambda p: F.lit(True)
    return {
        "assign": _spans(t, ASSIGN, ASSIGN, lambda p: F.length(F.regexp_extract(p, ASSIGN, 2)) >= 6),
        # these take whole runs, so the least length can stand in the pattern
        "access": _spans(t, "AKIA[A-Z0-9]{16}", "AKIA[A-Z0-9]{16,}", yes),
        "hex": _spans(t, "[0-9a-f]{24}", "[0-9a-f]{24,}", yes),
        "opaque": _spans(t, "[A-Za-z0-9+/]{20}", OPAQUE, all_kinds),
        "user": _spans(t, USER, USER, yes),
        "endpoint": _spans(t, ENDPOINT, ENDPOINT, yes),
    }


def _all(columns: tuple[str, ...]) -> Column:
    """array<struct<s, e, kind>> over several kinds."""

    def one(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(KINDS.index(kind)).alias("kind")))

    return F.concat(*map(one, columns))


def linked(parts: DataFrame, scope: int = 200) -> DataFrame:
    """``parts`` (id, h and the kinds' spans) to (id, h, weak array<struct<s, e, kind>>): weak spans with their complement in scope."""
    some = lambda *kinds: sum((F.size(k) for k in kinds), F.lit(0)) > 0
    live = parts.where(some("opaque", "user", "endpoint") & some(*_SECRET) & some(*_IDENTIFIER, "endpoint"))
    rows = live.select("id", "h", F.explode(_all(KINDS)).alias("x")).distinct().select("id", "h", "x.*")
    role = F.when(F.col("kind").isin([KINDS.index(k) for k in _SECRET]), "secret").when(
        F.col("kind").isin([KINDS.index(k) for k in _IDENTIFIER]), "identifier"
    ).otherwise("endpoint")
    cell = lambda at: F.floor(at / scope)
    weak = rows.where(F.col("kind") >= len(_BASE)).withColumn("cell", F.explode(F.sequence(cell(F.col("s") - scope), cell(F.col("e") + scope))))
    other = rows.select(
        F.col("id").alias("id2"), F.col("h").alias("h2"), F.col("s").alias("s2"), F.col("e").alias("e2"), role.alias("role"),
        F.explode(F.sequence(cell(F.col("s")), cell(F.col("e")))).alias("cell2"),
    )
    met = weak.join(
        other,
        (weak["h"] == other["h2"]) & (weak["cell"] == other["cell2"]) & weak["id"].eqNullSafe(other["id2"])
        & (F.col("s2") <= F.col("e") + scope) & (F.col("e2") >= F.col("s") - scope)
        & ((F.col("s2") != F.col("s")) | (F.col("e2") != F.col("e"))),
    )
    seen = met.groupBy("id", "h", "s", "e", "kind").agg(*(F.max(F.col("role") == r).alias(r) for r in ("secret", "identifier", "endpoint")))
    good = (
        F.when(F.col("kind") == KINDS.index("opaque"), F.col("identifier") | F.col("endpoint"))
        .when(F.col("kind") == KINDS.index("user"), F.col("secret"))
        .otherwise(F.col("secret") & F.col("identifier"))
    )
    return seen.where(good).groupBy("id", "h").agg(F.collect_list(F.struct("s", "e", "kind")).alias("weak"))


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, h (a hash of the row) and the kinds' spans of every row."""
    spans = scan(F.col(text))
    return docs.select(F.col(key).alias("id"), F.xxhash64(F.col(key), F.col(text)).alias("h"), *(c.alias(k) for k, c in spans.items()))


def with_weak(parts: DataFrame, scope: int = 200) -> DataFrame:
    """``parts`` with ``base`` and ``spans``: sorted array<struct<s, kind, e>>."""
    weak = linked(parts, scope).select(F.col("id").alias("id2"), F.col("h").alias("h2"), "weak")
    both = parts.join(weak, (parts["h"] == weak["h2"]) & parts["id"].eqNullSafe(weak["id2"]), "left")
    order = lambda a: F.array_sort(F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"))))
    none = F.array().cast("array<struct<s:int,e:int,kind:int>>")
    return both.select(
        *parts.columns, order(_all(_BASE)).alias("base"), order(F.concat(_all(_BASE), F.coalesce("weak", none))).alias("spans")
    )


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with every stretch of sorted spans replaced by one mark."""
    t = F.coalesce(text, F.lit(""))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(t, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], x["e"]).alias("at"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
