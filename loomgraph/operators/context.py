"""Context packs: scoring, greedy filling of a token budget, policy and security rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomgraph.functions.text import glob_regex, token_estimate
from loomgraph.schema import GraphTables
from loomgraph.session import written

#: Rules (id, severity, message, pattern), paths and replacement.
INJECTION = "Context contains prompt-injection-like instructions"
SECRET = "Context contains secret-like material"
RULES = (
    ("prompt.ignore_previous", "high", INJECTION, r"(?i)ignore (all )?(previous|prior) instructions"),
    ("prompt.system_override", "high", INJECTION, r"(?i)\b(system|developer) prompt\b"),
    ("prompt.exfiltrate", "high", INJECTION, r"(?i)\b(exfiltrate|leak|send).{0,40}\b(secret|token|key)"),
    ("secret.private_key", "high", SECRET, r"-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    ("secret.aws_key", "high", SECRET, r"\bAKIA[0-9A-Z]{16}\b"),
    ("secret.env_assignment", "high", SECRET, r"(?i)\b[A-Z0-9_]*(SECRET|TOKEN|PASSWORD|API_KEY)\s*="),
)
SECRET_PATTERNS = tuple(r[3] for r in RULES if r[0].startswith("secret."))
RISKY_PARTS = ("node_modules", "vendor", "dist", "build", ".venv", "__pycache__", "coverage", ".next")
VENDOR_PARTS = ("node_modules", "vendor", "dist", "build", ".venv", "__pycache__", ".next")
DENIED = (".env", ".env.*", "*.pem", "*.key", "id_rsa", "id_ed25519", "*.p12", "*.pfx", "secrets/**", "**/secrets/**", "*.tfvars")
REDACTION = "«redacted-secret»"


@dataclass(frozen=True)
class Policy:
    """What may enter a pack."""

    deny: tuple[str, ...] = field(default=DENIED)
    redact_secrets: bool = True
    allow_vendor: bool = False
    allow_tests: bool = True


# scoring


def heuristic_score(query: Column, rank: Column | None = None) -> Column:
    """100, 70 or 45 for a name, qualified name or path that equals, begins with or holds the query; more for text and rank."""
    q = F.lower(F.trim(query))
    fields = [F.lower(c) for c in ("name", "qualified_name", "file_path")]
    some = lambda test: test(fields[0]) | test(fields[1]) | test(fields[2])
    score = F.when(some(lambda f: f == q), 100.0).when(some(lambda f: f.startswith(q)), 70.0).when(some(lambda f: f.contains(q)), 45.0).otherwise(0.0)
    score = score + F.when(F.lower("docstring").contains(q), 12.0).otherwise(0.0) + F.when(F.lower("signature").contains(q), 8.0).otherwise(0.0)
    if rank is not None:
        score = score + F.coalesce(rank, F.lit(0.0)) * 100.0
    return F.round(score, 6)


def rank_candidates(found: DataFrame, g: GraphTables, queries: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """Search hits (query_id, id, rank) and exact names, ordered by heuristic score, first rank, file, line and id."""
    hits = found.select("query_id", "id", F.col("rank").alias("order"))
    exact = queries.join(g.symbols.select("id", "name"), F.col("query") == F.col("name")).select("query_id", "id")
    late = exact.join(hits, ["query_id", "id"], "left_anti").withColumn("order", F.lit(1_000_000))
    rows = hits.unionByName(late).join(queries, "query_id").join(g.symbols, "id")
    if ranks is not None:
        rows = rows.join(ranks.select("id", F.col("rank").alias("_pr")), "id", "left")
    rows = rows.withColumn("score", heuristic_score(F.col("query"), F.col("_pr") if ranks is not None else None))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "order", "file_path", "start_line", "id")
    return rows.withColumn("rank", F.row_number().over(w)).drop("order")


# packing


def greedy_fill(entries: DataFrame, budget: int, limit: int) -> DataFrame:
    """(query_id, used, kept, baseline) for ranked entries (query_id, rank, id, tokens), tokens not negative.

    In order of rank: the first entry always enters; one that would exceed the
    budget is skipped, and smaller ones after it may still enter, up to ``limit``.
    An entry behind ``limit`` others of its size never enters: each of those fits
    whenever it does, so the pack is full before. Only the first ``limit`` entries
    of each size within the budget are gathered, whatever the size of a group.
    """
    rows = entries.select("query_id", F.struct("rank", "id", F.col("tokens").cast("long").alias("tokens")).alias("row"), F.col("tokens"))
    heads = rows.groupBy("query_id").agg(F.min("row").alias("row"), F.sum("tokens").alias("baseline"))
    heads = heads.withColumn("row", F.when(F.col("row.tokens") > budget, F.col("row")))  # others are among the few
    place = F.row_number().over(Window.partitionBy("query_id", "tokens").orderBy("row"))
    few = rows.where(F.col("tokens") <= budget).withColumn("place", place).where(F.col("place") <= limit)
    few = few.select("query_id", "row", F.lit(None).cast(heads.schema["baseline"].dataType).alias("baseline"))
    packed = heads.unionByName(few).groupBy("query_id").agg(F.array_sort(F.collect_list("row")).alias("rows"), F.max("baseline").alias("baseline"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, e: Column) -> Column:
        fits = (F.size(acc["kept"]) < limit) & ((F.size(acc["kept"]) == 0) | (acc["used"] + e["tokens"] <= budget))
        return F.when(fits, F.struct((acc["used"] + e["tokens"]).alias("used"), F.array_append(acc["kept"], e["id"]).alias("kept"))).otherwise(acc)

    return packed.withColumn("fill", F.aggregate("rows", start, step)).select("query_id", "fill.used", "fill.kept", "baseline")


def file_summaries(g: GraphTables, symbols: int = 25) -> DataFrame:
    """(path, summary, tokens): each file's number of symbols and the first of them in order of line, as JSON."""
    place = F.row_number().over(Window.partitionBy("file_path").orderBy("start_line", "id"))
    first = g.symbols.withColumn("place", place).where(F.col("place") <= symbols)
    one = F.struct("place", "name", "qualified_name", "kind", (F.col("start_line") + 1).alias("line"))
    lists = first.groupBy("file_path").agg(F.array_sort(F.collect_list(one)).alias("symbols"))
    counts = g.symbols.groupBy("file_path").agg(F.count("*").alias("symbol_count"))
    rows = lists.join(counts, "file_path").withColumn("symbols", F.transform("symbols", lambda x: x.dropFields("place")))
    rows = rows.select(F.col("file_path").alias("path"), F.to_json(F.struct(F.col("file_path").alias("file"), "symbol_count", "symbols")).alias("summary"))
    return rows.withColumn("tokens", token_estimate(F.col("summary")))


def with_summaries(filled: DataFrame, files: DataFrame, sizes: DataFrame, budget: int) -> DataFrame:
    """Packs of ``greedy_fill`` with ``summaries``: the files (id, path) of kept entries whose summaries (path, tokens) still fit.

    In order of path, a summary that would exceed what is left of the budget is
    skipped, and smaller ones after it may still enter. The baseline is what was used at least.
    """
    own = filled.select("query_id", F.explode("kept").alias("id")).join(files, "id").select("query_id", "path").distinct()
    lists = own.join(sizes.select("path", F.col("tokens").cast("long").alias("tokens")), "path").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("path", "tokens"))).alias("files"))  # no more files than entries
    start = F.struct(F.col("used").alias("used"), F.array().cast("array<string>").alias("summaries"))

    def step(acc: Column, f: Column) -> Column:
        fits = acc["used"] + f["tokens"] <= budget
        return F.when(fits, F.struct((acc["used"] + f["tokens"]).alias("used"), F.array_append(acc["summaries"], f["path"]).alias("summaries"))).otherwise(acc)

    none = F.array().cast("array<struct<path:string,tokens:bigint>>")
    out = filled.join(lists, "query_id", "left").withColumn("fill", F.aggregate(F.coalesce("files", none), start, step))
    return out.select(*[c for c in filled.columns if c not in ("used", "baseline")], F.col("fill.used").alias("used"), F.greatest("baseline", "fill.used").alias("baseline"), F.col("fill.summaries").alias("summaries"))


def savings(used: Column, baseline: Column) -> Column:
    """The share of the baseline's tokens that a pack leaves out."""
    whole = F.greatest(used, baseline)
    return F.round(F.when(whole > 0, 1 - used / whole).otherwise(0.0), 4)


def entry_text(g: GraphTables, candidates: DataFrame, relations: int = 6) -> DataFrame:
    """Candidates as JSON entries with up to ``relations`` edges each way, and their token estimate."""
    ids = candidates.select("id").distinct()

    def side(own: str, other: str) -> DataFrame:
        edges = g.relationships.select(F.col(own).alias("id"), F.col(other).alias("other"), "kind", "confidence").join(ids, "id", "left_semi")
        w = Window.partitionBy("id").orderBy("other", "kind", "confidence")
        first = edges.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= relations)
        counts = edges.groupBy("id").agg(F.count("*").alias("n"))
        return first.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("other", "kind", "confidence"))).alias("list")).join(counts, "id")

    out, into = side("source_id", "target_id"), side("target_id", "source_id")
    rows = candidates.join(out.select("id", F.col("list").alias("outgoing"), F.col("n").alias("outgoing_count")), "id", "left").join(into.select("id", F.col("list").alias("incoming"), F.col("n").alias("incoming_count")), "id", "left")
    entry = F.to_json(F.struct("score", "name", "qualified_name", "kind", F.col("file_path").alias("file"), (F.col("start_line") + 1).alias("line"), "docstring", "signature", "outgoing", "incoming", F.coalesce("outgoing_count", F.lit(0)).alias("outgoing_count"), F.coalesce("incoming_count", F.lit(0)).alias("incoming_count")))
    return rows.withColumn("entry", entry).withColumn("tokens", token_estimate(entry))


def context_pack(g: GraphTables, candidates: DataFrame, budget: int = 2000, limit: int = 10, relations: int = 6, policy: Policy | None = None, summaries: bool = False) -> DataFrame:
    """One row a query: used, kept (ids), baseline, savings, excluded (files that the policy denies); with summaries those of files that still fit."""
    rows = candidates
    if policy is not None:
        rows = rows.withColumn("denied", is_denied(F.col("file_path"), policy) | (F.lit(not policy.allow_tests) & F.col("is_test")))
        if policy.redact_secrets:
            rows = rows.withColumns({c: redacted(F.col(c)) for c in ("docstring", "signature")})
        gone = rows.where("denied").groupBy("query_id").agg(F.count_distinct("file_path").alias("excluded"))
        rows = rows.where("not denied")
    entries = written(entry_text(g, rows, relations).select("query_id", "rank", "id", "tokens"), "entries")
    filled = greedy_fill(entries, budget, limit)
    if summaries:
        filled = with_summaries(filled, g.symbols.select("id", F.col("file_path").alias("path")), file_summaries(g), budget)
    filled = filled.withColumn("savings", savings(F.col("used"), F.col("baseline")))
    return filled.join(gone, "query_id", "left").na.fill(0, ["excluded"]) if policy is not None else filled


# policy and security


def is_denied(path: Column, policy: Policy = Policy()) -> Column:
    posix = F.replace(path, F.lit("\\"), F.lit("/"))
    name = F.substring_index(posix, "/", -1)
    rules = "|".join(glob_regex(p) for p in policy.deny)
    out = posix.rlike(rules) | name.rlike(rules)
    return out if policy.allow_vendor else out | F.arrays_overlap(F.split(posix, "/"), F.array(*map(F.lit, VENDOR_PARTS)))


def redacted(text: Column) -> Column:
    for pattern in SECRET_PATTERNS:
        text = F.regexp_replace(text, pattern, REDACTION)
    return text


def redactions(text: Column) -> Column:
    """How many spans are replaced; each pattern is counted on what the ones before have left."""
    n = F.lit(0)
    for pattern in SECRET_PATTERNS:
        n = n + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, REDACTION)
    return n


def findings(rows: DataFrame, text: str = "text", location: str = "location") -> DataFrame:
    """(location, rule_id, severity, message, snippet, line): at most one finding of a rule in a text."""
    one = [
        F.when(F.col(text).rlike(p), F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"), F.lit(m).alias("message"), F.regexp_extract(text, f"(?s)(.{{0,32}})((?-s){p})(.{{0,32}})", 0).alias("found"), F.regexp_instr(F.col(text), F.lit(p)).alias("at")))
        for r, s, m, p in RULES
    ]
    # nearly all texts are clean, and one look tells
    some = "|".join(f"(?:{p})" if not p.startswith("(?i)") else f"(?i:{p.removeprefix('(?i)')})" for _, _, _, p in RULES)
    hits = rows.where(F.col(text).rlike(some)).select(location, text, F.explode(F.array_compact(F.array(*one))).alias("f"))
    snippet = F.substring(F.replace(F.col("f.found"), F.lit("\n"), F.lit(" ")), 1, 160)
    line = 1 + F.regexp_count(F.substr(F.col(text), F.lit(1), F.greatest(F.lit(0), F.col("f.at") - 1)), F.lit("\n"))
    return hits.select(location, "f.rule_id", "f.severity", "f.message", snippet.alias("snippet"), line.alias("line"))


def risky_paths(paths: DataFrame, path: str = "path") -> DataFrame:
    parts = F.array_sort(F.array_intersect(F.split(F.replace(F.col(path), F.lit("\\"), F.lit("/")), "/"), F.array(*map(F.lit, RISKY_PARTS))))
    return paths.withColumn("parts", parts).where(F.size("parts") > 0).select(F.col(path).alias("location"), F.lit("path.generated_or_vendor").alias("rule_id"), F.lit("medium").alias("severity"), F.array_join("parts", ", ").alias("parts"))


def severity_order(severity: Column) -> Column:
    return F.when(severity == "high", 3).when(severity == "medium", 2).otherwise(1)


def scan_status(found: DataFrame) -> DataFrame:
    """One row: blocked if any finding is high, the largest severity, and their number."""
    worst = F.max(severity_order(F.col("severity")))
    name = F.when(worst == 3, "high").when(worst == 2, "medium").otherwise("low")
    return found.agg(F.when(worst == 3, "blocked").otherwise("ok").alias("status"), name.alias("max_severity"), F.count("*").alias("n_findings"))


def safety_report(files: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Counts over files (path, text): all, denied, with secrets, redactions."""
    denied = is_denied(F.col("path"), policy)
    n = redactions(F.coalesce("text", F.lit("")))
    return files.agg(F.count("*").alias("files"), F.count_if(denied).alias("denied"), F.count_if(n > 0).alias("with_secrets"), F.coalesce(F.sum(n), F.lit(0)).alias("redactions"))
