"""Secret scans through a trigram inverted index, in DataFrame functions alone.

From each rule's regular expression a Boolean query over trigrams of lower-case text is derived: what any match must hold.
The index posts, for each block of documents, the documents that hold each trigram some query names. A rule's
postings are intersected and united as its query says; only those documents are matched against the rule. A rule
whose expression has no mandatory trigram scans every document. Candidates are told by their identifiers and a number of rules, and
broadcast while they are at most CANDIDATES; beyond that they are joined.

Spans are found by matching "anything, then the rule or the end" over and over, which tells the lengths of gaps and
matches in one pass; running sums of those, made in runs of STEP, are code-point positions.

Cases: a null or empty text has no spans; a document with a null doc_id isn't in the index and is matched against every rule;
rows of one doc_id are candidates together and matched each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Identifiers of an index block, candidates that are broadcast (16 bytes each), matches whose places are summed up together.
BLOCK, CANDIDATES, STEP = 1024, 1 << 18, 256


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    #: Code points that the value (the last group of `groups`, or the match) has at least.
    least: int = 0
    groups: int = 0
    base: bool = False


# The base rules.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, True),
    Rule("hex", r"[0-9a-f]+", 24, 0, True),
)
MORE = (
    # to its END line; without one, its heading lines and what may be base64
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:\s*[A-Za-z]+-[A-Za-z]+: [^\n]*){0,3}(?:[^-]*-----END [A-Z ]{0,20}PRIVATE KEY-----|[A-Za-z0-9+/=\s]*)"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_password", r"[a-z]{2,12}://[A-Za-z0-9_.-]+:[^\s:@/]{3,}@[A-Za-z0-9]"),
)
RULES = BASE + MORE

# A query is True (anything), a trigram, or ("and" | "or", frozenset of queries).


def both(a, b):
    parts = frozenset().union(*(q[1] if q[0] == "and" else [q] for q in (a, b) if q is not True))
    return ("and", parts) if len(parts) > 1 else next(iter(parts), True)


def either(queries):
    queries = frozenset(queries)
    return True if True in queries else next(iter(queries)) if len(queries) == 1 else ("or", queries)


def of_string(s: str):
    query = True
    for i in range(len(s) - 2):
        query = both(query, s[i : i + 3])
    return query


def query_of(regex: str, most: int = 8):
    """The Boolean trigram query that every match of the expression satisfies, over lower-case text."""
    parser = re._parser

    def strings_of(op, arg) -> set[str] | None:
        """All strings that an element matches, in lower case, if they are few."""
        name = str(op)
        if name == "LITERAL":
            return {chr(arg).lower()}
        if name == "IN":
            found = set()
            for o, a in arg:
                if str(o) == "LITERAL":
                    found.add(chr(a).lower())
                elif str(o) == "RANGE" and a[1] - a[0] < most:
                    found |= {chr(x).lower() for x in range(a[0], a[1] + 1)}
                else:
                    return None
            return found if len(found) <= 4 else None
        if name == "SUBPATTERN":
            return all_strings(arg[3])
        if name == "BRANCH":
            parts = [all_strings(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if name in ("MAX_REPEAT", "MIN_REPEAT") and (arg[0], arg[1]) == (0, 1):
            inner = all_strings(arg[2])
            return None if inner is None else inner | {""}
        return None

    def all_strings(seq) -> set[str] | None:
        found = {""}
        for op, arg in seq:
            own = strings_of(op, arg)
            if own is None or len(found) * len(own) > most:
                return None
            found = {a + b for a in found for b in own}
        return found

    def walk(seq):
        query, run = True, {""}
        for op, arg in seq:
            own = strings_of(op, arg)
            if own is not None and len(run) * len(own) <= most:
                run = {a + b for a in run for b in own}
                continue
            query, run = both(query, either(map(of_string, run))), {""}
            name = str(op)
            if own is not None:
                run = own
            elif name == "SUBPATTERN":
                query = both(query, walk(arg[3]))
            elif name == "BRANCH":
                query = both(query, either(walk(x) for x in arg[1]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
                query = both(query, walk(arg[2]))
        return both(query, either(map(of_string, run)))

    return walk(parser.parse(regex))


def trigrams(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def postings(query, index: Column) -> Column:
    """The documents of a block that satisfy a query. index: its map of trigram to documents."""
    if isinstance(query, str):
        return F.coalesce(index[query], F.array().cast("array<long>"))
    first, *rest = (postings(q, index) for q in sorted(query[1], key=str))
    for x in rest:
        first = F.array_intersect(first, x) if query[0] == "and" else F.array_union(first, x)
    return first


def trigram_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """block, postings: for each block of identifiers a map of the rules' trigrams to the documents that hold them."""
    wanted = sorted(set().union(*(trigrams(query_of(r.regex)) for r in rules)))
    lower = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("lower"))
    marks = F.array_compact(F.array(*(F.when(F.contains("lower", F.lit(t)), F.lit(t)) for t in wanted))) if wanted else F.array().cast("array<string>")
    entries = lower.select("doc_id", F.explode(marks).alias("trigram")).withColumn("block", F.floor(F.col("doc_id") / BLOCK))
    lists = entries.groupBy("block", "trigram").agg(F.collect_set("doc_id").alias("docs"))
    return lists.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "docs"))).alias("postings"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, rules: a bit for each indexed rule whose query a document satisfies."""
    found = [(1 << at, query_of(r.regex)) for at, r in enumerate(rules)]
    each = F.array(*(F.struct(F.lit(bit).cast("long").alias("bit"), postings(q, F.col("postings")).alias("docs")) for bit, q in found if q is not True))
    hits = index.select(F.explode(each).alias("hit")).select("hit.bit", F.explode("hit.docs").alias("doc_id"))
    return hits.groupBy("doc_id").agg(F.bit_or("bit").alias("rules"))


def held(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans_of(text: Column, rule: Rule, at: int) -> Column:
    """array<struct<start, place, stop>> of a rule's matches in a text, in order."""
    pattern = F.lit(f"(?s)(.*?)(?:({rule.regex})|\\z)")
    gaps, matches = (F.transform(F.regexp_extract_all("text", pattern, F.lit(k)), lambda x: F.char_length(x)) for k in (1, 2))
    values = F.transform(F.regexp_extract_all("text", pattern, F.lit(2 + rule.groups)), lambda x: F.char_length(x)) if rule.groups else matches
    zipped = F.arrays_zip(gaps.alias("gap"), matches.alias("size"), values.alias("value"))
    none = F.array().cast("array<struct<start:int,place:int,stop:int>>")

    def step(state: Column, x: Column) -> Column:
        begin = state["pos"] + x["gap"]
        own = F.struct(begin.alias("start"), F.lit(at).alias("place"), (begin + x["size"]).alias("stop"))
        good = (x["size"] > 0) & (x["value"] >= rule.least)
        return F.struct((begin + x["size"]).alias("pos"), F.when(good, F.concat(state["out"], F.array(own))).otherwise(state["out"]).alias("out"))

    # a list grows by copies of itself, so it is made in short runs, each from the sum of the lengths before it
    def in_runs(all_of: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_of) - 1) / STEP).cast("int")), lambda k: F.slice(all_of, k * STEP + 1, STEP))
        return held(runs, with_places)

    def with_places(runs: Column) -> Column:
        sums = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda n, x: n + x["gap"] + x["size"]))
        return held(sums, lambda s: F.flatten(F.transform(runs, lambda r, k: F.aggregate(r, F.struct(F.aggregate(F.slice(s, F.lit(1), k), F.lit(0), lambda n, x: n + x).alias("pos"), none.alias("out")), step, lambda e: e["out"]))))

    return held(zipped, in_runs)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, into: str = "spans") -> DataFrame:
    """docs with a column `into`: array<struct<start, place, stop>> by start and then rule; place is the rule's number from 0."""
    found = materialise(candidates(trigram_index(docs, rules), rules).toDF("_candidate", "_rules"), "candidates")
    texts = docs.withColumn("text", F.coalesce("text", F.lit("")))
    if found.count() <= CANDIDATES:
        joined = texts.join(F.broadcast(found), F.col("doc_id") == F.col("_candidate"), "left")
    else:
        # rows without an identifier are dealt by their texts, to keys that none has
        nowhere = F.concat(F.lit("-"), F.xxhash64("text"))
        joined = texts.join(found, F.coalesce(F.col("doc_id").cast("long").cast("string"), nowhere) == F.col("_candidate").cast("string"), "left")
        joined = joined.withColumn("_rules", F.when(F.col("doc_id").isNotNull(), F.col("_rules")))
    none = F.array().cast("array<struct<start:int,place:int,stop:int>>")
    own = []
    for at, r in enumerate(rules):
        if query_of(r.regex) is True:
            # a long run is a match alone, so rare texts go on to the full pass
            run = re.fullmatch(r"(\[[^]]+\])\+", r.regex)
            maybe = F.col("text").rlike(f"{run[1]}{{{r.least}}}" if run and r.least else r.regex)
        else:
            maybe = F.col("doc_id").isNull() | (F.coalesce("_rules", F.lit(0)).bitwiseAND(F.lit(1 << at)) != 0)
        own.append(F.when(maybe, spans_of(F.col("text"), r, at)).otherwise(none))
    return joined.withColumn(into, F.sort_array(F.concat(*own))).drop("_candidate", "_rules")


def written(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:stop of spans, joined by commas."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["place"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def of_rule(place: int):
    return lambda span: span["place"] == place


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document the base rules' counts and digest, and all spans."""
    base = sum(r.base for r in rules)
    rows = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rules).select("doc_id", "spans")
    count = [F.size(F.filter("spans", of_rule(k))).cast("long").alias(f"n_{rules[k].kind}") for k in range(base)]
    return rows.select("doc_id", *count, F.sha2(written(F.filter("spans", lambda s: s["place"] < base), rules), 256).alias("base_sha256"), written(F.col("spans"), rules).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each run of overlapping spans replaced by `mark`, and n_chars as it then is."""
    columns = docs.columns
    rows = scan(docs, rules, "_spans")
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["pos"]
        gap = F.substring("text", state["pos"] + 1, F.greatest(F.lit(0), s["start"] - state["pos"]))
        return F.struct(F.greatest(state["pos"], s["stop"]).alias("pos"), F.when(fresh, F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"]).alias("out"))

    done = F.aggregate("_spans", start, step, lambda s: F.concat(s["out"], F.substring("text", s["pos"] + 1, F.char_length("text"))))
    clean = F.when(F.size("_spans") > 0, done).otherwise(F.col("text"))
    return rows.withColumn("text", clean).withColumn("n_chars", F.char_length("text").cast("long")).select(columns)


def oracle_sql() -> str:
    """The report as DuckDB SQL: every rule over every text, without an index."""
    parts = []
    for at, r in enumerate(RULES):
        pattern = f"(?s)(.*?)(?:({r.regex})|\\z)".replace("'", "''")
        parts.append(f"""
        SELECT doc_id, {at} AS place, '{r.kind}' AS kind, stop - size AS start, stop FROM (
          SELECT doc_id, size, value, SUM(gap + size) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM (
            SELECT doc_id, k, COALESCE(length(g[k]), 0) AS gap, COALESCE(length(m[k]), 0) AS size, COALESCE(length(v[k]), 0) AS value FROM (
              SELECT doc_id, g, m, v, unnest(generate_series(1, len(g))) AS k FROM (
                SELECT doc_id, regexp_extract_all(text, '{pattern}', 1) AS g, regexp_extract_all(text, '{pattern}', 2) AS m, regexp_extract_all(text, '{pattern}', {2 + r.groups}) AS v FROM texts))))
        WHERE size > 0 AND value >= {r.least}""")
    base = sum(r.base for r in RULES)
    counts = ", ".join(f"COUNT(*) FILTER (WHERE place = {k})::BIGINT AS n_{RULES[k].kind}" for k in range(base))
    listed = "COALESCE(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place){}, '')"
    return f"""
    WITH texts AS (SELECT doc_id, COALESCE(text, '') AS text FROM documents), found AS ({" UNION ALL ".join(parts)})
    SELECT doc_id, {counts}, sha256({listed.format(f" FILTER (WHERE place < {base})")}) AS base_sha256, {listed.format("")} AS spans
    FROM (SELECT doc_id FROM texts) LEFT JOIN (SELECT doc_id, place, kind, start::BIGINT AS start, stop::BIGINT AS stop FROM found) USING (doc_id)
    GROUP BY doc_id"""
