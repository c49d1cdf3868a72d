"""Secret scans judged by corpus-wide ownership, in DataFrame functions only.

Candidates are cut out of every text by regular expressions; split and
extract run the same engine, so the lengths of the gaps and hits give exact
code-point offsets.  The hash of each candidate value is then counted over the
whole corpus by distinct owners (``source``) and repositories (different texts of an owner, so that
copies of one text count once): a value that many owners or many repositories carry is an example
people copy around, one that few carry and that looks random is taken for live.

Texts are read once and never shuffled; what moves is one small row per hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import fresh_name
from quillmesh.session import materialise

# Kinds in their fixed order, each with its pattern, the group
# that holds the secret, and the least length of that group.
KINDS = (
    ("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
)
# A private key is its whole block: header, body without five hyphens in a row, footer.  Where the footer is
# missing the lines of base64 after the header are taken; a header alone is a mention, not a key.
_BLANK = "(?:\\\\[nr]|[\\x20\\x09-\\x0D])"


def _private_key(once: str) -> str:
    """``once`` is "+" for possessive repetition, which Java's engine runs as a loop: a key of any length needs no stack.

    No repetition here ever has to give anything back, so without the marks an
    engine that knows none, as DuckDB's, matches the same.
    """
    return (
        f"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*{once}(?:-{{1,4}}{once}[^-]+{once})*{once}-----END [A-Z ]*PRIVATE KEY-----"
        f"|(?:{_BLANK}*{once}(?:Proc-Type|DEK-Info):[^\\x0A\\\\]*{once})*{once}(?:{_BLANK}*{once}[A-Za-z0-9+/=]{{16,}}{once})+{once}"
        f"(?:{_BLANK}+{once}[A-Za-z0-9+/]{{1,15}}{once}={{1,2}})?)"
    )


# What the hash of a block leaves out: all keys of a type share it, or it depends on how the text is laid out.
_AROUND_KEY = f"-----(?:BEGIN|END) [A-Z ]*PRIVATE KEY-----|{_BLANK}"

# Kinds that the ownership method adds; their spans count only when owner-specific.
def _added(once: str) -> tuple:
    return ("key", _private_key(once) + _TOKENS, 0, 1)


_TOKENS = (
    "|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}"
    "|eyJ[A-Za-z0-9_-]{10,}\\.eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]+|AIza[A-Za-z0-9_-]{35}"
)
ADDED = (_added("+"),)
ALL_KINDS = KINDS + ADDED
PLAIN_KINDS = (*KINDS, _added(""))  # the same for engines without possessive repetition

# Cheap substring tests; a text that passes none cannot hold a hit of that kind.
_HINTS = {"assign": ("passw", "secret", "token", "api"), "access": ("AKIA",), "key": ("-----BEGIN", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "eyJ", "AIza")}

MAX_OWNERS = 4
MAX_REPOSITORIES = 16
REDACTION = "[REDACTED]"


def _maybe(text: Column, kind: str, pattern: str) -> Column:
    if kind not in _HINTS:
        return text.rlike(pattern)
    # a long s or Kelvin sign lowers to ASCII; that only lets a text through to the exact pattern
    low = F.lower(text) if kind == "assign" else text
    hit = F.lit(False)
    for hint in _HINTS[kind]:
        hit = hit | low.contains(hint)
    return hit


def _cuts(text: Column, order: int) -> Column:
    """Per match of one kind: length of the gap before it, its own length, value, and whether it is long enough."""
    kind, pattern, group, least = ALL_KINDS[order]
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    cuts = F.transform(
        F.arrays_zip(whole.alias("m"), value.alias("v"), F.slice(gaps, 1, F.size(whole)).alias("g")),
        lambda x, i: F.struct(
            F.lit(order).alias("kind_no"),
            i.alias("nth"),
            F.length(x["g"]).alias("gap"),
            F.length(x["m"]).alias("len"),
            x["v"].alias("value"),
            (F.length(x["v"]) >= least).alias("fits"),
        ),
    )
    empty = F.array().cast("array<struct<kind_no:int,nth:int,gap:int,len:int,value:string,fits:boolean>>")
    return F.when(_maybe(text, kind, pattern), cuts).otherwise(empty)


def may_hold_secrets(text: str = "text") -> Column:
    """True for every text with a hit (and possibly others)."""
    body = F.coalesce(F.col(text), F.lit(""))
    hit = F.lit(False)
    for kind, pattern, _, _ in ALL_KINDS:
        hit = hit | (_maybe(body, kind, pattern) & body.rlike(pattern))
    return hit


def candidates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", owner: str = "source") -> tuple[DataFrame, DataFrame]:
    """(one row per document, one row per hit), the first written so that row numbers stay the same.

    Hits carry ``row_id, doc_id, owner, kind_no, kind, start, end, value_hash,
    random_looking, text_key`` with offsets in code points.  Null text: no hits.  A null owner counts
    as one owner of its own; rows that repeat stay separate rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    found = F.concat(*[_cuts(body, k) for k in range(len(ALL_KINDS))])
    scanned = materialise(
        docs.select(
            F.monotonically_increasing_id().alias("row_id"),
            F.col(doc_id).cast("long").alias("doc_id"),
            F.coalesce(F.col(owner).cast("string"), F.lit("\x00")).alias("owner"),
            found.alias("found"),
            body.alias("__body"),
        ).select("row_id", "doc_id", "owner", "found", F.when(F.size("found") > 0, F.md5("__body")).alias("text_key")),
        "secret-scan",
    )
    hits = scanned.filter(F.size("found") > 0).select("row_id", "doc_id", "owner", "text_key", F.inline("found"))
    along = Window.partitionBy("row_id", "kind_no").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.sum(F.col("gap") + F.col("len")).over(along)
    names = F.array(*[F.lit(k[0]) for k in ALL_KINDS])
    hits = hits.select("*", ends.alias("end")).filter("fits")
    value = F.col("value")
    body = F.when(value.startswith("-----BEGIN"), F.regexp_replace(value, _AROUND_KEY, "")).otherwise(value)
    hits = hits.withColumn("value", body)
    return scanned.select("row_id", "doc_id"), hits.select(
        "row_id",
        "doc_id",
        "owner",
        "text_key",
        "kind_no",
        F.get(names, F.col("kind_no")).alias("kind"),
        (F.col("end") - F.col("len")).alias("start"),
        "end",
        F.xxhash64("value").alias("value_hash"),
        _looks_random(F.col("value"), F.col("kind_no")).alias("random_looking"),
    )


def _looks_random(value: Column, kind_no: Column) -> Column:
    """Eight different characters; a shorter assigned value when it mixes kinds of characters and hardly repeats any."""
    different = F.size(F.array_distinct(F.split(value, "")))
    mixed = sum(value.rlike(kind).cast("int") for kind in ("[a-z]", "[A-Z]", "[0-9]", "[+/_.=-]"))
    short = (kind_no == 0) & (mixed >= 2) & (4 * different >= 3 * F.length(value))
    return (different >= 8) | short


def ownership(hits: DataFrame) -> DataFrame:
    """``value_hash, n_owners, n_repositories``: two steps, so that a hot value is combined before it is shuffled."""
    per_text = hits.groupBy("value_hash", "owner", "text_key").agg(F.count(F.lit(1)).alias("n"))
    per_owner = per_text.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return per_owner.groupBy("value_hash").agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories")
    )


def judged(hits: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """Hits with ``n_owners, n_repositories, copied, live``.

    A value is copied when more than ``max_owners`` owners or more than
    ``max_repositories`` repositories hold it; one that is not and looks random is live.
    """
    copied = (F.col("n_owners") > max_owners) | (F.col("n_repositories") > max_repositories)
    known = hits.join(ownership(hits), "value_hash").withColumn("copied", copied)
    return known.withColumn("live", ~F.col("copied") & F.col("random_looking"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """One row per document: counts per kind, spans, how many values look live or copied, and the most owners
    and repositories that any of its values has.

    ``spans`` holds the base spans and the owner-specific spans of the added
    kinds, by start and then kind, as ``kind:start:end`` with commas.
    """
    rows, hits = candidates(docs)
    hits = judged(materialise(hits, "secret-hits"), max_owners, max_repositories)
    base = F.col("kind_no") < len(KINDS)
    span = F.struct("start", "kind_no", "end", "kind")
    per_row = (
        hits.filter(base | F.col("live"))
        .groupBy("row_id")
        .agg(
            *[F.count_if(F.col("kind") == k[0]).alias(f"n_{k[0]}") for k in KINDS],
            F.sort_array(F.collect_list(F.when(base, span))).alias("base"),
            F.sort_array(F.collect_list(span)).alias("all"),
            F.count_if("live").alias("n_live"),
            F.count_if("copied").alias("n_copied"),
            F.max("n_owners").alias("most_owners"),
            F.max("n_repositories").alias("most_repositories"),
        )
    )
    counts = [*[f"n_{k[0]}" for k in KINDS], "n_live", "n_copied", "most_owners", "most_repositories"]
    none = F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>")
    return rows.join(per_row, "row_id", "left").select(
        "doc_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts[:3]],
        F.sha2(_joined(F.coalesce("base", none)), 256).alias("base_sha256"),
        _joined(F.coalesce("all", none)).alias("spans"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts[3:]],
    )


def redact(docs: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """Replace live-looking secrets in ``text`` (and refresh ``n_chars`` where there is one).

    Widely copied examples stay.  Texts that cannot hold a secret pass through
    untouched and unshuffled; the others meet their spans by text, so equal
    texts are treated alike.  All other columns stay, whatever their names.
    """
    key, cuts_name, end_name = (fresh_name(docs, n) for n in ("__text_key", "__cuts", "__tail"))
    _, hits = candidates(docs)
    live = judged(materialise(hits, "secret-hits"), max_owners, max_repositories).filter("live")
    live = live.groupBy("text_key", "start", "end").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("text_key").orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ordered = live.withColumn("from", F.coalesce(F.max("end").over(before), F.lit(0)))
    cuts = ordered.groupBy(F.col("text_key").alias(key)).agg(
        F.sort_array(
            F.collect_list(F.when(F.col("start") >= F.col("from"), F.struct("start", "from")))
        ).alias(cuts_name),
        F.max("end").alias(end_name),
    )
    suspect = may_hold_secrets()
    pieces = F.transform(
        cuts_name,
        lambda c: F.substring(F.col("text"), (c["from"] + 1).cast("int"), (c["start"] - c["from"]).cast("int")),
    )
    tail = F.substring(F.col("text"), (F.col(end_name) + 1).cast("int"), F.length("text"))
    clean = F.array_join(F.concat(pieces, F.array(tail)), REDACTION)
    columns = {c: F.col(f"`{c}`") for c in docs.columns}
    columns["text"] = F.when(F.col(end_name).isNull(), F.col("text")).otherwise(clean)
    changed = docs.filter(suspect).withColumn(key, F.md5("text")).join(cuts, key, "left")
    rewritten = changed.select(*[c.alias(name) for name, c in columns.items()])
    if "n_chars" in docs.columns:
        rewritten = rewritten.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.filter(~suspect).unionByName(rewritten)
