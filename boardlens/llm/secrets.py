"""Secret scans with corpus-wide ownership frequency (DataFrame functions only).

Candidates come from patterns of assignments, access keys, long hex runs,
provider formats and bare strings. The hash of each candidate's value is
aggregated over the whole corpus by distinct repositories and owners: a value
that many owners hold, or two owners in many repositories, is a copied example;
one that a single owner holds, in however many repositories, or two in a few,
looks like a live credential of theirs. A bare string elsewhere whose hash is
that of such a credential is a span of its own kind (``reuse``), so a leak is
found even where nothing around it says so. A private key's span reaches from
its header to its END line (or the end of its body), and its value is the body
without white space and fields, so keys count apart and a copy that is wrapped
otherwise counts with its original.

Places are code points, end exclusive; of one kind, spans are leftmost and do
not overlap. Spark gives no match offsets, so they are the running lengths of
what lies between and in the matches.

Matches of a text are folded by runs of ``FOLD``, so a text of very many matches
copies no long list for each.

Nulls and odd rows: a null text is empty and has no spans; a null repository or
owner counts as one unnamed of its own; rows that repeat are kept and do not
change counts of distinct owners; an empty table gives an empty result; names
beginning with ``_sc_`` are reserved, columns named ``secrets`` or ``base`` are
replaced, others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlens.llm import shared

#: Kinds in the order that breaks ties of equal starts.
KINDS = ("assign", "access", "hex", "format", "reuse")
BASE_KINDS = 3

# A private key: header, then all up to its END line; without one, RFC 1421 fields and base64 lines (line ends may be escaped).
_LINE = r"(?:\s|\\[nrt])*+"
_KEY_HEAD, _KEY_END = r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----END [A-Z ]*PRIVATE KEY-----"
_KEY_BODY = rf"(?:{_LINE}[A-Z][A-Za-z-]*:\x20[^\r\n\\]*+){{0,8}}+(?:{_LINE}[A-Za-z0-9+/]{{24,}}+={{0,2}}+){{0,1024}}+(?:{_LINE}[A-Za-z0-9+/]{{1,23}}+={{0,2}}+(?=\x20*(?:[\r\n\\\"']|\z)))?+"
_KEY = rf"{_KEY_HEAD}(?:[^-]{{0,32768}}+(?:-{{1,4}}+(?!-)[^-]{{0,32768}}+){{0,64}}+{_KEY_END}|{_KEY_BODY})"
#: What a key's value leaves out: its first and last line, fields, and all that is no base64.
_NO_KEY = rf"{_KEY_HEAD}|{_KEY_END}|(?<![A-Za-z-])[A-Z][A-Za-z-]*:\x20[^\r\n\\]*|\\[nrt]|[^A-Za-z0-9+/=]"
#: Base64 runs so long hold placeholder words by chance; with so many distinct characters they are none.
KEY_CHARACTERS, KEY_DISTINCT = 64, 24

# The patterns, their value group, the least length of that group, and a cheaper test of a text.
_WORDS = r"password|passwd|secret|token|api_?key"
PATTERNS = {
    "assign": (rf"""((?i){_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, rf"""(?i)(?:{_WORDS})["']?\x20*[:=]"""),
    "access": (r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    "hex": (r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
    "format": (
        r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+|" + _KEY,
        0,
        0,
        r"gh[pousr]_|xox[abprs]-|AIza|[sr]k_(?:live|test)_|eyJ[A-Za-z0-9_-]{8}|-----BEGIN ",
    ),
    "reuse": (r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*[0-9])[A-Za-z0-9+/_.=-]{12,}", 0, 12, r"[A-Za-z0-9+/_.=-]{12}"),
}
#: Hex runs are matched at their full least length at once (a maximal run holds one match at most).
_FASTER = {"hex": r"[0-9a-f]{24,}"}
PLACEHOLDER = r"(?i)example|sample|changeme|placeholder|dummy|redacted|x{4,}|\*{4,}|your[_-]"
#: Distinct owners from which on a value is a copied example.
EXAMPLE_OWNERS = 3
#: Distinct repositories of two owners from which on a value is one, too.
EXAMPLE_REPOS = 5
#: Matches of a text that are folded together.
FOLD = 256
#: Distinct characters that a live-looking value has at least.
LIVE_CHARACTERS = 6


def _value(match: Column) -> Column:
    """What is hashed of a match: of a private key its body (the header alone, if it has none)."""
    body = F.regexp_replace(match, _NO_KEY, "")
    return F.when(match.startswith("-----BEGIN ") & (body != ""), body).otherwise(match)


def find_spans(text: Column, kind: str) -> Column:
    """array<struct<start, end, kind, value>> of one kind in a text (null for a null text)."""
    pattern, group, least, test = PATTERNS[kind]
    p = F.lit(_FASTER.get(kind, pattern))
    spans = "array<struct<start:int,end:int,kind:int,value:string>>"
    parts = F.arrays_zip(
        F.split(text, _FASTER.get(kind, pattern), -1).alias("gap"),
        F.regexp_extract_all(text, p, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, p, F.lit(group)).alias("value"),
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        one = F.struct(start.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("kind"), (_value(x["value"]) if kind == "format" else x["value"]).alias("value"))
        out = F.when(x["match"].isNotNull() & (F.length(x["value"]) >= least), F.concat(acc["out"], F.array(one))).otherwise(acc["out"])
        return F.struct(end.alias("pos"), out.cast(spans).alias("out"))

    none = F.array().cast(spans)
    # Runs of matches, each folded from where the one before it ended.
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / FOLD).cast("int")), lambda i: F.slice(parts, i * FOLD + 1, F.lit(FOLD)))
    begin = lambda acc: F.struct(F.coalesce(F.get(acc, F.size(acc) - 1)["pos"], F.lit(0)).alias("pos"), none.alias("out"))
    folded = F.array().cast(f"array<struct<pos:int,out:{spans}>>")
    found = F.aggregate(runs, folded, lambda acc, run: F.concat(acc, F.array(F.aggregate(run, begin(acc), step))), lambda acc: F.flatten(F.transform(acc, lambda r: r["out"])))
    return F.when(text.rlike(test), found).otherwise(none)


def scan(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``_sc_spans`` of all kinds (value as its hash) and ``_sc_row``."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    every = F.concat(*[find_spans(t, k) for k in KINDS])

    def shape(value: Column) -> Column:
        distinct = F.size(F.array_distinct(F.split(value, "")))
        body = value.rlike(rf"^[A-Za-z0-9+/=]{{{KEY_CHARACTERS},}}$") & (distinct >= KEY_DISTINCT)
        return (distinct >= LIVE_CHARACTERS) & (body | ~value.rlike(PLACEHOLDER))

    hashed = F.transform(
        every,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["kind"].alias("kind"),
            s["end"].alias("end"),
            F.sha2(s["value"], 256).alias("hash"),
            shape(s["value"]).alias("shape"),
        ),
    )
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.array_sort(hashed).alias("_sc_spans"), F.monotonically_increasing_id().alias("_sc_row"))


def ownership(scanned: DataFrame, *, repo: str, owner: str, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """One row per candidate hash: n_found, n_repos, n_owners, named (found by more than a bare string), verdict.

    Counting runs over (hash, repository, owner) first, combined map-side, so a
    value in a third of all rows is a few rows per task.
    """
    unnamed = F.concat(F.lit("\0"), F.col("_sc_row").cast("string"))
    s = F.explode("_sc_spans")
    cand = scanned.select(F.coalesce(F.col(repo).cast("string"), unnamed).alias("r"), F.coalesce(F.col(owner).cast("string"), unnamed).alias("o"), s.alias("s"))
    held = cand.groupBy(F.col("s.hash").alias("hash"), "r", "o").agg(F.count("*").alias("n"), F.max(F.col("s.kind") != KINDS.index("reuse")).alias("named"), F.max("s.shape").alias("shape"))
    by = held.groupBy("hash").agg(F.sum("n").alias("n_found"), F.count_distinct("r").alias("n_repos"), F.count_distinct("o").alias("n_owners"), F.max("named").alias("named"), F.max("shape").alias("shape"))
    copied = (F.col("n_owners") >= example_owners) | (F.col("n_owners") > 1) & (F.col("n_repos") >= example_repos)
    verdict = F.when(copied | ~F.col("shape"), "example").otherwise("live")
    return by.where("named").select("hash", "n_found", "n_repos", "n_owners", verdict.alias("verdict"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of spans in their order, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, *, text: str = "text", repo: str = "source", owner: str = "source", example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """``docs`` without its text, with ``secrets`` and ``base``; ``repo`` and ``owner`` name its columns of those.

    ``secrets``: array<struct<start, kind, end, hash, verdict>> of all spans
    (kind as a number in KINDS), ``base``: the same of the base kinds, which
    are never withdrawn. A bare string counts (kind ``reuse``) only if its hash
    is a live-looking credential elsewhere and no other span starts and ends
    where it does.
    """
    scanned = shared.materialise(scan(docs.drop("secrets", "base"), text=text), "secrets")
    own = [c for c in scanned.columns if not c.startswith("_sc_")]
    verdicts = ownership(scanned, repo=repo, owner=owner, example_owners=example_owners, example_repos=example_repos)
    spans = scanned.where(F.size("_sc_spans") > 0).select("_sc_row", F.explode("_sc_spans").alias("s"))
    judged = spans.select("_sc_row", "s.*").join(verdicts.select("hash", "verdict"), "hash", "left")
    judged = judged.where((F.col("kind") != KINDS.index("reuse")) | (F.col("verdict") == "live"))
    judged = judged.groupBy("_sc_row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "hash", "verdict"))).alias("secrets"))
    rows = scanned.join(judged, "_sc_row", "left")
    none = F.array().cast(judged.schema["secrets"].dataType)
    secrets = F.coalesce("secrets", none)
    reuse = KINDS.index("reuse")
    # A bare string inside a named span is that span.
    secrets = F.filter(secrets, lambda s: (s["kind"] != reuse) | ~F.exists(F.filter(secrets, lambda o: o["kind"] != reuse), lambda o: (o["start"] <= s["start"]) & (o["end"] >= s["end"])))
    return rows.select(*own, secrets.alias("secrets"), F.filter(secrets, lambda s: s["kind"] < BASE_KINDS).alias("base"))
