"""Queries of scoring, statistics and set logic, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamizal.functions import predicates as P
from tamizal.functions import text as T
from tamizal.operators import evalstats as E
from tamizal.plans import sql as S
from tamizal.sources.tables import spread, table

_KEY = ("id", "system", "attempt")


def _runs(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Runs told apart by their key; rows logged again count once."""
    return table(spark, folder, "runs").select(*_KEY, *columns).dropDuplicates(list(_KEY))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    bank = table(spark, folder, "question_bank").select("id", "category", "type", "must", "abstain")
    r = _runs(spark, folder, "answer").join(bank, "id")
    return r.select(*_KEY, "category", "type", "abstain", P.outcome(F.col("must"), F.col("abstain"), F.col("type"), F.col("answer")).alias("outcome"))


def text_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The text-layer verdict on every document."""
    q = P.with_text_quality(spread(table(spark, folder, "documents").select("doc_id", "text")))
    return q.select("doc_id", *(f"quality.{c}" for c in ("status", "reason", "characters", "words", "alphanumeric_ratio", "digit_ratio", "suspicious_ratio")))


def router_rules(spark: SparkSession, folder: str) -> DataFrame:
    """What the rules alone make of every query: category, outside the domain, and how many passages to fetch."""
    q = F.col("q")
    return table(spark, folder, "queries").select("id", "query", P.rule_text(F.col("query")).alias("q")).select("id", P.rule_route(q).alias("rule"), P.outside_domain(q).alias("outside"), P.top_k(F.col("query")).alias("top_k"))


def router_confusion(spark: SparkSession, folder: str) -> DataFrame:
    """True category against the rules' category, zeros included."""
    q = table(spark, folder, "queries").where("categoria_correcta is not null").select("categoria_correcta", P.rule_text(F.col("query")).alias("q")).select("categoria_correcta", P.rule_route(F.col("q")).alias("rule"))
    return E.confusion(q, "categoria_correcta", "rule", ["CRONOGRAMA", "VACANTES", "TEMARIO", "REGLAMENTO", "FUERA_DE_DOMINIO"])


def router_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Precision, recall and F1 of the rules by category."""
    q = table(spark, folder, "queries").select("categoria_correcta", P.rule_text(F.col("query")).alias("q")).select("categoria_correcta", P.rule_route(F.col("q")).alias("rule"))
    return E.precision_recall(q, "categoria_correcta", "rule")


def router_slices(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy of the logged router by who decided (rule or model) and over all, before and after the evidence override."""
    bank = table(spark, folder, "question_bank").select("id", "category")
    r = _runs(spark, folder, "router", "pred_category", "ood_override").join(bank, "id")
    by_rule = F.coalesce(F.col("router").startswith("rule:"), F.lit(False))
    after = P.reversed_verdict(F.col("pred_category"), F.col("ood_override.category"), F.col("ood_override.best_score"), by_rule)
    right = lambda c: F.sum(F.coalesce((c == F.col("category")).cast("int"), F.lit(0)))
    rows = r.select("category", "pred_category", after.alias("after"), F.when(by_rule, "rule").otherwise("model").alias("decided"))
    return rows.groupingSets([[F.col("decided")], []], F.col("decided")).agg(F.count("*").alias("runs"), right(F.col("pred_category")).alias("right_before"), right(F.col("after")).alias("right_after"))


def cache_compatible(spark: SparkSession, folder: str) -> DataFrame:
    """Which queries may share an answer with their paraphrase."""
    return table(spark, folder, "queries").where("parafrasis is not null").select("id", P.same_anchors(F.col("query"), F.col("parafrasis")).alias("compatible"))


def abstentions(spark: SparkSession, folder: str) -> DataFrame:
    """By system and phase, the answers that say the information is missing."""
    r = _runs(spark, folder, "phase", "answer")
    return r.groupBy("system", "phase").agg(F.count("*").alias("runs"), F.sum(P.abstains(F.col("answer")).cast("int")).alias("abstained"))


def outcome_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes by system, over all, by category and by type of question."""
    s = _scored(spark, folder)
    slices = F.array(F.lit("all"), F.concat(F.lit("category "), F.col("category")), F.concat(F.lit("type "), F.col("type")), F.when(F.col("abstain"), "must abstain").otherwise("answerable"))
    n = lambda x: F.sum((F.col("outcome") == x).cast("int"))
    return s.select("system", "outcome", F.explode(slices).alias("slice")).groupBy("system", "slice").agg(F.count("*").alias("runs"), n("correct").alias("correct"), n("abstained").alias("abstained"), n("wrong").alias("wrong"))


def _first_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each system got each question right, in its first attempt."""
    s = _scored(spark, folder).groupBy("id", "system").agg(F.min_by("outcome", "attempt").alias("outcome"))
    return s.select("id", "system", (F.col("outcome") == "correct").alias("good"))


def mcnemar_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Each pair of systems on the questions both answered."""
    return E.mcnemar(_first_attempts(spark, folder), "id", "system", "good")


def holm_adjusted(spark: SparkSession, folder: str) -> DataFrame:
    """The same p values, adjusted for the number of pairs."""
    p = mcnemar_exact(spark, folder).select("a", "b", "p", F.concat_ws("|", "a", "b").alias("pair"))
    return E.holm(p.withColumn("family", F.lit(1)), ["family"], "p", "pair").select("pair", "p", "adjusted")


def bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy of each system with its bootstrap interval."""
    return E.bootstrap(_first_attempts(spark, folder), "system", "id", "good")


def paired_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy difference of each system to the first one, with its interval over common questions."""
    g = _first_attempts(spark, folder)
    base = g.where("system = 'V1'").select("id", F.col("good").alias("base"))
    d = g.where("system <> 'V1'").join(base, "id").select("system", "id", (F.col("good").cast("int") - F.col("base").cast("int")).alias("difference"))
    return E.bootstrap(d, "system", "id", "difference", seed=2)


def cohens_kappa(spark: SparkSession, folder: str) -> DataFrame:
    """Agreement of the first two attempts' outcomes of each question and system."""
    s = _scored(spark, folder).where("attempt in (1, 2)").groupBy("id", "system").agg(F.max(F.when(F.col("attempt") == 1, F.col("outcome"))).alias("a"), F.max(F.when(F.col("attempt") == 2, F.col("outcome"))).alias("b"))
    return E.kappa(s, "a", "b")


def wilcoxon_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Signed-rank sums of the seconds of each system against V1, question by question."""
    t = _runs(spark, folder, "elapsed_s").where("elapsed_s is not null and not isnan(elapsed_s)").groupBy("id", "system").agg(F.round(F.min("elapsed_s"), 3).alias("s"))
    base = t.where("system = 'V1'").select("id", F.col("s").alias("base"))
    d = t.where("system <> 'V1'").join(base, "id").select("system", F.round(F.col("s") - F.col("base"), 3).alias("difference"))
    return E.wilcoxon(d, ["system"], "difference")


def latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds by phase: mean, deviation, both medians, nearest-rank percentiles."""
    return E.describe(_runs(spark, folder, "phase", "elapsed_s"), ["phase"], "elapsed_s")


def stage_share(spark: SparkSession, folder: str) -> DataFrame:
    """Sum of event values by type and hour and its share of the hour, and of all."""
    e = table(spark, folder, "events").select(F.hour("ts").alias("hour"), "event_type", F.round("value", 4).cast("decimal(20,4)").alias("value"))
    return E.shares(e, ["hour"], "event_type", "value").select("hour", "event_type", "n", F.round(F.col("total").cast("double"), 4).alias("total"), F.col("share").cast("double").alias("share"))


def multiset_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Of each bank answer's integers, how many the first answer of each system repeats."""
    bank = table(spark, folder, "question_bank").where("gold is not null").select("id", F.explode(T.integers(F.col("gold"))).alias("n"))
    first = _runs(spark, folder, "answer").groupBy("id", "system").agg(F.min_by("answer", "attempt").alias("answer"))
    key = F.concat_ws("|", "id", "system").alias("run")
    wanted = bank.join(first.select("id", "system"), "id").select(key, "n")
    return E.multiset_overlap(wanted, first.select(key, F.explode(T.integers(F.col("answer"))).alias("n")), "run", "n")


def number_support(spark: SparkSession, folder: str) -> DataFrame:
    """By system, answers whose numbers all stand in the contexts or the query."""
    r = _runs(spark, folder, "query", "answer", "contexts").where("answer is not null")
    ok = P.supported_numbers(F.col("answer"), F.array_join("contexts", " "), F.col("query"))
    return r.groupBy("system").agg(F.count("*").alias("runs"), F.sum(ok.cast("int")).alias("supported"))


def set_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Share of the bank answer's words that the paraphrased ground truth of the same query has."""
    q = table(spark, folder, "queries").where("ground_truth is not null").select("id", F.array_distinct(T.tokens(F.col("query"))).alias("a"), F.array_distinct(T.tokens(F.col("ground_truth"))).alias("b"))
    return q.where(F.size("a") > 0).select("id", F.round(F.size(F.array_intersect("a", "b")) / F.size("a"), 6).alias("coverage"))


def retrieval_recall(spark: SparkSession, folder: str) -> DataFrame:
    """By system, runs whose contexts hold all that the question demands, and the contexts' characters."""
    bank = table(spark, folder, "question_bank").where("not abstain and size(must) > 0").select("id", "must")
    r = _runs(spark, folder, "contexts").join(bank, "id").select("system", "must", T.fold(F.array_join("contexts", " ")).alias("context"))
    hit = F.forall("must", lambda p: F.rlike(F.col("context"), p))
    return r.groupBy("system").agg(F.count("*").alias("runs"), F.sum(hit.cast("int")).alias("recalled"), F.sum(F.length("context")).alias("characters"))


def run_audit(spark: SparkSession, folder: str) -> DataFrame:
    """How many runs raise each combination of flags, in the order of the nine checks."""
    bank = table(spark, folder, "question_bank").select("id", T.norm(F.col("query")).alias("bank_query"))
    r = table(spark, folder, "runs").groupBy(*_KEY).agg(F.min_by(F.struct("query", "answer", "error", "pred_category", "elapsed_s", "contexts", "phase", "started_utc", "logged_utc"), "logged_utc").alias("r")).select("id", "r.*").join(bank, "id", "left")
    said = F.coalesce("answer", F.lit(""))
    flags = P.ordered_flags(
        ("error", F.col("error").isNotNull()), ("no_answer", F.coalesce(F.trim("answer") == "", F.lit(True))), ("no_category", F.col("pred_category").isNull()),
        ("bad_time", F.coalesce(F.isnan("elapsed_s") | (F.col("elapsed_s") < 0), F.lit(True))), ("no_context", F.coalesce(F.size("contexts") <= 0, F.lit(True)) & (F.col("phase") != "router_ood")),
        ("abstains", P.abstains(said)), ("other_numbers", ~P.supported_numbers(said, F.array_join("contexts", " "), F.coalesce("query", F.lit("")))), ("other_query", ~T.norm(F.col("query")).eqNullSafe(F.col("bank_query"))),
        ("logged_late", F.unix_micros("logged_utc") - F.unix_micros("started_utc") > 86_400_000_000),
    )
    return r.groupBy(F.array_join(flags, ",").alias("flags")).agg(F.count("*").alias("runs"))


def missing_answers(spark: SparkSession, folder: str) -> DataFrame:
    """By system, bank questions with an answer, without one, and never asked: the questions joined with first attempts, a default where there is none."""
    r = _runs(spark, folder, "answer")
    systems = r.select("system").distinct()
    wanted = table(spark, folder, "question_bank").select("id").crossJoin(F.broadcast(systems))  # a fixed table times a few names
    first = r.groupBy("id", "system").agg(F.min_by(F.struct("answer"), "attempt")["answer"].alias("answer")).withColumn("state", F.when(F.coalesce(F.trim("answer") == "", F.lit(True)), "no_answer").otherwise("answered"))
    return E.with_defaults(wanted, first, ("id", "system"), {"state": F.lit("not_asked")}).groupBy("system", "state").agg(F.count("*").alias("questions"))


def phase_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and deviation of the seconds of each phase, and its share of all seconds."""
    return E.stage_profile(_runs(spark, folder, "phase", "elapsed_s"), "phase", "elapsed_s")


def run_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Runs by system, phase and predicted category, with all subtotals of the roll-up."""
    return _runs(spark, folder, "phase", "pred_category").rollup("system", "phase").agg(F.count("*").alias("runs"), F.count("pred_category").alias("labelled"))


def promotion_gate(spark: SparkSession, folder: str) -> DataFrame:
    """What blocks the query bank: missing fields and repeated queries."""
    q = table(spark, folder, "queries")
    miss = lambda c: F.sum(F.col(c).isNull().cast("int")).alias(f"no_{c}")
    return q.agg(F.count("*").alias("rows"), miss("categoria_correcta"), miss("parafrasis"), miss("ground_truth"), (F.count("query") - F.countDistinct("query")).alias("repeated"))


def leakage_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Normalized queries that stand both in the bank and in the query log."""
    a = table(spark, folder, "question_bank").select(T.norm(F.col("query")).alias("norm"))
    return a.intersect(table(spark, folder, "runs").select(T.norm(F.col("query")).alias("norm")))


def query_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Questions that a system ran and another did not, for every two systems."""
    r = table(spark, folder, "runs").select("id", "system").distinct()
    others = r.select(F.col("system").alias("other")).distinct()
    every = r.crossJoin(F.broadcast(others)).where("system <> other")  # a few systems
    return every.join(r.withColumnRenamed("system", "other"), ["id", "other"], "left_anti").select("id", "system", "other")


def dedup_keep_first(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each category, query and truth without regard to case: the lowest id."""
    q = table(spark, folder, "queries")
    return q.groupBy("categoria_correcta", F.lower("query").alias("asked"), F.lower("ground_truth").alias("truth")).agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Three documents of each language in id order, and three by seeded hash."""
    d = table(spark, folder, "documents").select("lang", "doc_id")
    return E.stratified(d, "lang", "doc_id", 3).withColumn("how", F.lit("first")).unionByName(E.stratified(d, "lang", "doc_id", 3, seed=7).withColumn("how", F.lit("seeded")))


def budget_cap(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of each customer in date order as long as their running total stays within 400,000."""
    o = table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    kept = E.within_budget(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "price", 400_000)
    return kept.select("o_custkey", "o_orderkey", F.col("spent").cast("double").alias("spent"))


def resume_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Questions each system has yet to run a tenth attempt of."""
    bank = table(spark, folder, "question_bank").select("id")
    r = table(spark, folder, "runs")
    want = bank.crossJoin(F.broadcast(r.select("system").distinct()))  # a fixed table times a few names
    return want.join(r.where("attempt = 10").select("id", "system"), ["id", "system"], "left_anti")


def lww_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The last logged row of each run (last write wins) and how often it was logged."""
    r = table(spark, folder, "runs").select(*_KEY, "logged_utc")
    return r.groupBy(*_KEY).agg(F.unix_micros(F.max("logged_utc")).alias("logged_us"), F.count("*").alias("times"))


def sha_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text another document with a lower id already has."""
    d = table(spark, folder, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha"))
    first = d.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return d.join(first, "sha").where("doc_id <> first").select("doc_id", "first")


def cache_stats(spark: SparkSession, folder: str) -> DataFrame:
    """By system, the share of runs that the cache answered, and its five questions with most hits."""
    r = _runs(spark, folder, "phase")
    hit = (F.col("phase") == "cache_hit").cast("int")
    s = r.groupBy("system").agg(F.round(F.sum(hit) / F.greatest(F.count("*"), F.lit(1)), 6).alias("hit_rate"))
    top = r.groupBy("system", "id").agg(F.sum(hit).alias("hits"))
    w = Window.partitionBy("system").orderBy(F.desc("hits"), F.asc("id"))
    top = top.withColumn("rank", F.row_number().over(w)).where("rank <= 5").groupBy("system").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]), ",").alias("top"))
    return s.join(top, "system")


def page_contiguity(spark: SparkSession, folder: str) -> DataFrame:
    """Of each source its segments, characters and pages, and whether pages are numbered without a gap."""
    v = table(spark, folder, "vacantes").where("source is not null").select("id", "source", "page", F.length("text").alias("size")).dropDuplicates(["id"])
    return v.groupBy("source").agg(F.count("*").alias("segments"), F.sum("size").alias("characters"), F.countDistinct("page").alias("pages"), (F.max("page") - F.min("page") + 1 == F.countDistinct("page")).alias("contiguous"))


QUERIES = {
    f.__name__: f
    for f in (
        text_quality, router_rules, router_confusion, router_scores, router_slices, cache_compatible, abstentions, outcome_scoring, mcnemar_exact, holm_adjusted, bootstrap_ci, paired_bootstrap,
        cohens_kappa, wilcoxon_ranks, latency_percentiles, stage_share, multiset_overlap, number_support, set_coverage, retrieval_recall, run_audit, missing_answers, phase_profile, run_counts, promotion_gate, leakage_overlap,
        query_sets, dedup_keep_first, stratified_sample, budget_cap, resume_anti, lww_upsert, sha_dedup, cache_stats, page_contiguity,
    )
}

_Q = "regexp_replace({}, '\\s+', ' ', 'g')".format(S.fold("query"))
_RULE = (
    "CASE WHEN regexp_matches(q, '" + P.INTENT_RULES[0][1] + "') THEN 'TEMARIO' WHEN "
    + " OR ".join(f"regexp_matches(q, '{p}')" for p in P.OUTSIDE_RULES)
    + " THEN 'FUERA_DE_DOMINIO' "
    + " ".join(f"WHEN regexp_matches(q, '{p}') THEN '{label}'" for label, p in P.INTENT_RULES[1:])
    + f" WHEN regexp_matches(q, '{P.TEMPORAL}') AND regexp_matches(q, '{P.SUBJECT}') THEN 'CRONOGRAMA' END"
)
_ROUTED = f"(SELECT *, {_RULE} AS rule FROM (SELECT *, {_Q} AS q FROM queries))"
_RUN = "(SELECT DISTINCT * EXCLUDE (logged_utc) FROM runs)"
_ANSWER = S.fold("coalesce(r.answer, '')")
_BARE = f"regexp_replace(regexp_replace(a, '[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}', ' ', 'g'), '(pagina|pag\\.?|p\\.)\\s*[0-9]+', ' ', 'g')"
_SCORED = f"""
    marked AS (SELECT r.id, r.system, r.attempt, b.category, b.type, b.abstain, b.must, {_ANSWER} AS a FROM {_RUN} r JOIN question_bank b ON b.id = r.id),
    judged AS (SELECT *, regexp_matches(a, '{P.ABSTENTION}') AS gives_up, len(list_filter(coalesce(must, []), lambda p: NOT regexp_matches(a, p))) = 0 AS ok,
               type = 'lookup' AND len(list_distinct(regexp_extract_all({_BARE}, '(?:^|[^0-9.,])([0-9]+)', 1))) > 5 AS many FROM marked),
    scored AS (SELECT *, CASE WHEN abstain THEN CASE WHEN gives_up THEN 'correct' ELSE 'wrong' END WHEN ok AND many THEN 'wrong' WHEN ok AND NOT (gives_up AND length(a) < 120) THEN 'correct'
               WHEN gives_up THEN 'abstained' ELSE 'wrong' END AS outcome FROM judged),
    firsts AS (SELECT id, system, arg_min(outcome, attempt) = 'correct' AS good FROM scored GROUP BY id, system)"""
_PAIRS = f"""{_SCORED}, pairs AS (SELECT x.system AS a, y.system AS b, count(*) AS n, sum((x.good AND NOT y.good)::INT) AS only_a, sum((NOT x.good AND y.good)::INT) AS only_b
        FROM firsts x JOIN firsts y ON y.id = x.id AND x.system < y.system GROUP BY ALL),
    tails AS (SELECT *, CASE WHEN only_a + only_b = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(only_a, only_b)::BIGINT + 1),
              lambda k: exp(lgamma((only_a + only_b + 1)::DOUBLE) - lgamma((k + 1)::DOUBLE) - lgamma((only_a + only_b - k + 1)::DOUBLE) - (only_a + only_b) * ln(2))))) END AS p FROM pairs)"""


def _bootstrap(rows: str, value: str, seed: int) -> str:
    mix = "xor((t * 1103515245 + 12345) % 2147483648, ((t * 1103515245 + 12345) % 2147483648) >> 16)"
    times = " + ".join(f"(t >= {x})::INT" for x in E.POISSON)
    return f"""held AS (SELECT system, ({value})::DOUBLE AS v, ('0x' || md5(id)[1:7])::BIGINT AS h FROM {rows}),
        mixed AS (SELECT system, v, rep, {mix} AS t FROM (SELECT system, v, rep, {mix} AS t FROM (SELECT system, v, rep, {mix} AS t FROM (SELECT system, v, rep, (h + rep * 40503 + {seed * 7919}) % 2147483648 AS t FROM held, (SELECT unnest(range(10000)) AS rep))))),
        means AS (SELECT system, rep, sum(v * c) / nullif(sum(c), 0) AS m FROM (SELECT system, rep, v, {times} AS c FROM mixed) GROUP BY ALL),
        ordered AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY m, rep) - 1 AS at_ FROM means),
        sizes AS (SELECT system, count(*) AS n, round(avg(v), 6) AS mean FROM held GROUP BY system)
        SELECT s.system, s.n, s.mean, round(max(CASE WHEN at_ = 250 THEN m END), 6) AS low, round(max(CASE WHEN at_ = 9750 THEN m END), 6) AS high FROM sizes s JOIN ordered o ON o.system = s.system GROUP BY ALL"""


_TERM = ", ".join(f"'{g}'" for g in P.GENERIC_TERMS)


def _words(x: str) -> str:
    return f"list_distinct(list_filter(list_transform({S.tokens(x)}, lambda t: {S.fold('t')}), lambda t: length(t) >= 4 AND NOT list_contains([{_TERM}], t) AND NOT regexp_matches(t, '[0-9]')))"


_INTS = "unnest(list_transform(regexp_extract_all(coalesce({x}, ''), '[0-9]+'), lambda i: regexp_replace(i, '^0+([0-9])', '\\1')))"

ORACLES = {
    "text_quality": """
        WITH m AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\s\\p{Z}\\x{85}\\x0b]', '', 'g') AS c FROM documents),
        n AS (SELECT doc_id, t, length(c) AS characters, length(regexp_replace(c, '[^\\p{L}]', '', 'g')) AS letters, length(regexp_replace(c, '[^\\p{Nd}]', '', 'g')) AS digits,
              length(regexp_replace(c, '[^\\x{FFFD}\\p{Cc}\\p{Co}]', '', 'g')) AS odd, len(regexp_extract_all(t, '[\\p{L}\\p{N}_]{2,}')) AS words,
              len(list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ') <> '' AND regexp_matches(trim(x, ' ' || chr(9) || chr(13)), '\\s{2,}|\\t'))) AS table_like FROM m),
        r AS (SELECT *, CASE WHEN characters > 0 THEN (letters + digits) / characters ELSE 0.0 END AS alnum, CASE WHEN letters + digits > 0 THEN digits / (letters + digits) ELSE 0.0 END AS dense, CASE WHEN characters > 0 THEN odd / characters ELSE 0.0 END AS lost FROM n),
        w AS (SELECT *, CASE WHEN characters < 28 THEN 'too_little_native_text' WHEN lost > 0.01 THEN 'suspicious_characters' WHEN alnum < 0.55 THEN 'low_alphanumeric_ratio' WHEN table_like >= 2 AND characters >= 40 THEN 'readable_layout_or_table_rows'
              WHEN words >= 5 AND characters >= 48 THEN 'enough_readable_word_tokens' WHEN characters >= 80 AND alnum >= 0.85 AND dense >= 0.35 THEN 'dense_numeric_or_table_text' ELSE 'native_text_below_conservative_threshold' END AS reason FROM r)
        SELECT doc_id, CASE WHEN reason IN ('readable_layout_or_table_rows', 'enough_readable_word_tokens', 'dense_numeric_or_table_text') THEN 'native_text' ELSE 'needs_ocr' END AS status, reason, characters, words,
               round(alnum, 4) AS alphanumeric_ratio, round(dense, 4) AS digit_ratio, round(lost, 4) AS suspicious_ratio FROM w""",
    "router_rules": f"SELECT id, rule, {' OR '.join(f'regexp_matches(q, {chr(39)}{p}{chr(39)})' for p in P.OUTSIDE_RULES)} AS outside, CASE WHEN regexp_matches({S.norm('query')}, '{P.LIST_QUERY}') THEN 10 ELSE 5 END AS top_k FROM {_ROUTED}",
    "router_confusion": f"""WITH l AS (SELECT unnest(['CRONOGRAMA', 'VACANTES', 'TEMARIO', 'REGLAMENTO', 'FUERA_DE_DOMINIO']) AS x), c AS (SELECT categoria_correcta, rule, count(*) AS n FROM {_ROUTED} GROUP BY ALL)
        SELECT a.x AS categoria_correcta, b.x AS rule, coalesce(n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN c ON c.categoria_correcta = a.x AND c.rule = b.x""",
    "router_scores": f"""WITH r AS (SELECT categoria_correcta AS t, rule AS g FROM {_ROUTED}), l AS (SELECT t AS label FROM r WHERE t IS NOT NULL UNION SELECT g FROM r WHERE g IS NOT NULL),
        s AS (SELECT label, count(*) FILTER (t = label) AS support, count(*) FILTER (g = label) AS guesses, count(*) FILTER (t = label AND g = label) AS hits FROM l, r GROUP BY label),
        p AS (SELECT *, coalesce(hits / nullif(guesses, 0), 0) AS p, coalesce(hits / nullif(support, 0), 0) AS r FROM s)
        SELECT label, support, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM p""",
    "router_slices": f"""WITH r AS (SELECT b.category, r.pred_category AS before_, coalesce(starts_with(router, 'rule:'), false) AS by_rule, ood_override AS o FROM {_RUN} r JOIN question_bank b ON b.id = r.id),
        s AS (SELECT *, CASE WHEN before_ = 'FUERA_DE_DOMINIO' AND NOT by_rule AND o.best_score >= 0.5 THEN o.category ELSE before_ END AS after_, CASE WHEN by_rule THEN 'rule' ELSE 'model' END AS decided FROM r)
        SELECT decided, count(*) AS runs, sum(coalesce(before_ = category, false)::INT) AS right_before, sum(coalesce(after_ = category, false)::INT) AS right_after FROM s GROUP BY GROUPING SETS ((decided), ())""",
    "cache_compatible": f"""WITH w AS (SELECT id, {_words('query')} AS a, {_words('parafrasis')} AS b, {S.number_tokens('query')} AS x, {S.number_tokens('parafrasis')} AS y FROM queries WHERE parafrasis IS NOT NULL)
        SELECT id, x = y AND (len(a) = 0 OR len(b) = 0 OR list_has_any(a, b)) AS compatible FROM w""",
    "abstentions": f"SELECT system, phase, count(*) AS runs, sum(coalesce(regexp_matches({S.fold('answer')}, '{P.ABSTENTION}'), false)::INT) AS abstained FROM {_RUN} GROUP BY ALL",
    "outcome_scoring": f"""WITH {_SCORED} SELECT system, slice, count(*) AS runs, sum((outcome = 'correct')::INT) AS correct, sum((outcome = 'abstained')::INT) AS abstained, sum((outcome = 'wrong')::INT) AS wrong
        FROM (SELECT system, outcome, unnest(['all', 'category ' || category, 'type ' || type, CASE WHEN abstain THEN 'must abstain' ELSE 'answerable' END]) AS slice FROM scored) GROUP BY ALL""",
    "mcnemar_exact": f"WITH {_PAIRS} SELECT a, b, n, only_a, only_b, round(p, 6) AS p FROM tails",
    "holm_adjusted": f"""WITH {_PAIRS}, o AS (SELECT a || '|' || b AS pair, round(p, 6) AS p, row_number() OVER (ORDER BY round(p, 6), a || '|' || b) AS i, count(*) OVER () AS m FROM tails)
        SELECT pair, p, round(least(1.0, max(p * (m - i + 1)) OVER (ORDER BY i)), 6) AS adjusted FROM o""",
    "bootstrap_ci": f"WITH {_SCORED}, {_bootstrap('firsts', 'good', 1)}",
    "paired_bootstrap": f"WITH {_SCORED}, d AS (SELECT f.id, f.system, f.good::INT - b.good::INT AS difference FROM firsts f JOIN firsts b ON b.id = f.id AND b.system = 'V1' WHERE f.system <> 'V1'), {_bootstrap('d', 'difference', 2)}",
    "cohens_kappa": f"""WITH {_SCORED}, r AS (SELECT * FROM (SELECT id, system, max(outcome) FILTER (attempt = 1) AS a, max(outcome) FILTER (attempt = 2) AS b FROM scored GROUP BY id, system) WHERE a IS NOT NULL AND b IS NOT NULL),
        pe AS (SELECT sum(x * y) AS xy FROM (SELECT a AS l, count(*) AS x FROM r GROUP BY a) JOIN (SELECT b AS l, count(*) AS y FROM r GROUP BY b) USING (l)),
        s AS (SELECT count(*) AS n, avg((a = b)::INT) AS po, any_value(xy) / (count(*) * count(*)) AS pe FROM r, pe)
        SELECT n, round(po, 6) AS agreement, round(CASE WHEN pe = 1 THEN 1.0 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM s""",
    "wilcoxon_ranks": f"""WITH RECURSIVE dist(n, c) AS (SELECT 0, [1.0::DOUBLE] UNION ALL SELECT n + 1, list_transform(range(0, len(c) + n + 1), lambda i: coalesce(c[i + 1], 0) + CASE WHEN i > n THEN coalesce(c[i - n], 0) ELSE 0 END) FROM dist WHERE n < 50),
        t AS (SELECT id, system, round(min(elapsed_s), 3) AS s FROM {_RUN} WHERE elapsed_s IS NOT NULL AND NOT isnan(elapsed_s) GROUP BY ALL),
        d AS (SELECT t.system, round(t.s - b.s, 3) AS x FROM t JOIN t b ON b.id = t.id AND b.system = 'V1' WHERE t.system <> 'V1'),
        r AS (SELECT *, rank() OVER (PARTITION BY system ORDER BY abs(x)) + (count(*) OVER (PARTITION BY system, abs(x)) - 1) / 2 AS rk FROM d WHERE x <> 0),
        s AS (SELECT system, count(*) AS n, sum(CASE WHEN x > 0 THEN rk ELSE 0 END) AS w_plus, sum(CASE WHEN x < 0 THEN rk ELSE 0 END) AS w_minus FROM r GROUP BY system),
        z AS (SELECT *, least(w_plus, w_minus) AS w, (least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24) AS z FROM s),
        tie AS (SELECT system, sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT system, abs(x) AS a, count(*)::DOUBLE AS c FROM d WHERE x <> 0 GROUP BY ALL) GROUP BY system),
        x_ AS (SELECT system, abs(w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) / sqrt(2) AS x FROM z JOIN tie USING (system)),
        -- the complementary error function as an integral over 20,000 steps
        tail AS (SELECT system, round(CASE WHEN z.n <= 50 AND ties = 0 THEN least(1.0, 2 * list_sum(dist.c[1:floor(w)::INT + 1]) / pow(2, z.n)) ELSE least(1.0, 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(20000), lambda i: exp(-pow((i + 0.5) * x / 20000, 2)))) * x / 20000) END, 4) AS p FROM x_ JOIN z USING (system) JOIN tie USING (system) LEFT JOIN dist ON dist.n = z.n)
        SELECT system, n, w_plus, w_minus, w, round((w_plus - w_minus) / (w_plus + w_minus), 6) AS rank_biserial, round(z, 6) AS z, round(abs(z) / sqrt(n), 6) AS effect_r, p FROM z JOIN tail USING (system)""",
    "latency_percentiles": f"""SELECT phase, count(v) AS n, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS deviation, min(v) AS least, max(v) AS most, round(quantile_cont(v, 0.5), 6) AS median,
        quantile_disc(v, 0.9) AS p90, quantile_disc(v, 0.95) AS p95, quantile_disc(v, 0.99) AS p99, list_sort(list(v))[count(v) // 2 + 1] AS upper_median
        FROM (SELECT phase, elapsed_s AS v FROM {_RUN} WHERE elapsed_s IS NOT NULL AND NOT isnan(elapsed_s)) GROUP BY phase""",
    "stage_share": """WITH e AS (SELECT hour(ts) AS hour, event_type, round(value, 4)::DECIMAL(20,4) AS value FROM events), g AS (SELECT hour, event_type, count(*) AS n, sum(value) AS total FROM e GROUP BY GROUPING SETS ((hour, event_type), (event_type)))
        SELECT hour, event_type, n, round(total::DOUBLE, 4) AS total, round(total::DOUBLE / sum(total) OVER (PARTITION BY hour)::DOUBLE, 6) AS share FROM g""",
    "multiset_overlap": f"""WITH a AS (SELECT id, system, arg_min(coalesce(answer, ''), attempt) AS answer FROM {_RUN} GROUP BY id, system),
        e AS (SELECT id || '|' || system AS run, n, count(*) AS e FROM (SELECT id, {_INTS.format(x='gold')} AS n FROM question_bank WHERE gold IS NOT NULL) JOIN a USING (id) GROUP BY ALL),
        f AS (SELECT run, n, count(*) AS f FROM (SELECT id || '|' || system AS run, {_INTS.format(x='answer')} AS n FROM a) GROUP BY ALL)
        SELECT run, sum(e) AS expected, sum(least(e, coalesce(f, 0))) AS matched, round(sum(least(e, coalesce(f, 0))) / sum(e), 6) AS share FROM e LEFT JOIN f USING (run, n) GROUP BY run""",
    "number_support": f"""SELECT system, count(*) AS runs, sum((len(list_filter({S.number_tokens('answer')}, lambda n: NOT list_contains(allowed, n))) = 0)::INT) AS supported
        FROM (SELECT system, answer, list_concat({S.number_tokens("array_to_string(contexts, ' ')")}, {S.number_tokens('query')}) AS allowed FROM {_RUN} WHERE answer IS NOT NULL) GROUP BY system""",
    "set_coverage": f"SELECT id, round(len(list_intersect(a, b)) / len(a), 6) AS coverage FROM (SELECT id, list_distinct({S.tokens('query')}) AS a, list_distinct({S.tokens('ground_truth')}) AS b FROM queries WHERE ground_truth IS NOT NULL) WHERE len(a) > 0",
    "retrieval_recall": f"""SELECT system, count(*) AS runs, sum((len(list_filter(must, lambda p: NOT regexp_matches(c, p))) = 0)::INT) AS recalled, sum(length(c)) AS characters
        FROM (SELECT r.system, b.must, {S.fold("array_to_string(r.contexts, ' ')")} AS c FROM {_RUN} r JOIN question_bank b ON b.id = r.id WHERE NOT b.abstain AND len(b.must) > 0) GROUP BY system""",
    "run_audit": f"""WITH r AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY id, system, attempt ORDER BY logged_utc) = 1)
        SELECT flags, count(*) AS runs FROM (SELECT coalesce(nullif(concat_ws(',', CASE WHEN r.error IS NOT NULL THEN 'error' END, CASE WHEN coalesce(trim(answer, ' ') = '', true) THEN 'no_answer' END, CASE WHEN pred_category IS NULL THEN 'no_category' END,
        CASE WHEN coalesce(isnan(elapsed_s) OR elapsed_s < 0, true) THEN 'bad_time' END, CASE WHEN coalesce(len(contexts), 0) = 0 AND phase <> 'router_ood' THEN 'no_context' END,
        CASE WHEN regexp_matches({S.fold("coalesce(answer, '')")}, '{P.ABSTENTION}') THEN 'abstains' END,
        CASE WHEN len(list_filter({S.number_tokens("coalesce(answer, '')")}, lambda n: NOT list_contains(list_concat({S.number_tokens("array_to_string(contexts, ' ')")}, {S.number_tokens("coalesce(r.query, '')")}), n))) > 0 THEN 'other_numbers' END,
        CASE WHEN {S.norm('r.query')} IS DISTINCT FROM {S.norm('b.query')} THEN 'other_query' END, CASE WHEN epoch_us(logged_utc) - epoch_us(started_utc) > 86400000000 THEN 'logged_late' END), ''), 'ok') AS flags
        FROM r LEFT JOIN question_bank b ON b.id = r.id) GROUP BY flags""",
    "missing_answers": f"""WITH f AS (SELECT id, system, arg_min_null(answer, attempt) AS answer FROM {_RUN} GROUP BY id, system)
        SELECT s.system, CASE WHEN f.id IS NULL THEN 'not_asked' WHEN coalesce(trim(answer, ' ') = '', true) THEN 'no_answer' ELSE 'answered' END AS state, count(*) AS questions
        FROM question_bank b CROSS JOIN (SELECT DISTINCT system FROM runs) s LEFT JOIN f ON f.id = b.id AND f.system = s.system GROUP BY ALL""",
    "phase_profile": f"""WITH v AS (SELECT phase, CASE WHEN NOT isnan(elapsed_s) THEN elapsed_s END AS x FROM {_RUN})
        SELECT phase, count(x) AS n, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS deviation, round(sum(x) / (SELECT sum(x) FROM v), 9) AS share FROM v GROUP BY phase""",
    "run_counts": f"SELECT system, phase, count(*) AS runs, count(pred_category) AS labelled FROM {_RUN} GROUP BY ROLLUP (system, phase)",
    "promotion_gate": 'SELECT count(*) AS "rows", count(*) FILTER (categoria_correcta IS NULL) AS no_categoria_correcta, count(*) FILTER (parafrasis IS NULL) AS no_parafrasis, count(*) FILTER (ground_truth IS NULL) AS no_ground_truth, count(query) - count(DISTINCT query) AS repeated FROM queries',
    "leakage_overlap": f"SELECT {S.norm('query')} AS norm FROM question_bank INTERSECT SELECT {S.norm('query')} FROM runs",
    "query_sets": """WITH r AS (SELECT DISTINCT id, system FROM runs) SELECT r.id, r.system, o.system AS other FROM r, (SELECT DISTINCT system FROM runs) o
        WHERE o.system <> r.system AND NOT EXISTS (SELECT 1 FROM r x WHERE x.id = r.id AND x.system = o.system)""",
    "dedup_keep_first": "SELECT categoria_correcta, lower(query) AS asked, lower(ground_truth) AS truth, min(id) AS id, count(*) AS copies FROM queries GROUP BY ALL",
    "stratified_sample": """SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank, 'first' AS how FROM documents QUALIFY rank <= 3
        UNION ALL SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS rank, 'seeded' FROM documents QUALIFY rank <= 3""",
    "budget_cap": "SELECT * FROM (SELECT o_custkey, o_orderkey, sum(o_totalprice::DECIMAL(18,2)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::DOUBLE AS spent FROM orders) WHERE spent <= 400000",
    "resume_anti": "SELECT b.id, s.system FROM question_bank b CROSS JOIN (SELECT DISTINCT system FROM runs) s WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.id = b.id AND r.system = s.system AND r.attempt = 10)",
    "lww_upsert": "SELECT id, system, attempt, epoch_us(max(logged_utc)) AS logged_us, count(*) AS times FROM runs GROUP BY ALL",
    "sha_dedup": "SELECT doc_id, first FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents WHERE text IS NOT NULL) WHERE doc_id <> first",
    "cache_stats": f"""WITH r AS (SELECT system, id, (phase = 'cache_hit')::INT AS hit FROM {_RUN}), t AS (SELECT * FROM (SELECT system, id, sum(hit) AS hits FROM r GROUP BY system, id) QUALIFY row_number() OVER (PARTITION BY system ORDER BY hits DESC, id) <= 5)
        SELECT s.system, s.hit_rate, string_agg(t.id, ',' ORDER BY hits DESC, t.id) AS top FROM (SELECT system, round(sum(hit) / greatest(count(*), 1), 6) AS hit_rate FROM r GROUP BY system) s JOIN t ON t.system = s.system GROUP BY s.system, s.hit_rate""",
    "page_contiguity": """SELECT source, count(*) AS segments, sum(size) AS characters, count(DISTINCT page) AS pages, max(page) - min(page) + 1 = count(DISTINCT page) AS contiguous
        FROM (SELECT DISTINCT id, source, page, length(text) AS size FROM vacantes WHERE source IS NOT NULL) GROUP BY source""",
}
