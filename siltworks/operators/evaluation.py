"""Evaluation analytics: scores, calibration, paired statistics, agents, graders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..plans.catalog import query
from ..plans.prefix import ranked
from ..plans.shared import cut, join_checked
from ..sources.derived import DATED, dated

# ---- forecasts: arm x topic x probability --------------------------------------------------------
_P = f"WITH {DATED}, f AS (SELECT d.doc_id, d.doc_id % 3 AS arm, CASE WHEN stream IN ('deaths', 'wiki') THEN 'trained' ELSE 'held-out' END AS band, source, CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE (d.doc_id * 37 % 101) / 100.0::DOUBLE END AS p, quality AS y FROM d JOIN labels l USING (doc_id))"


def _forecasts(t) -> DataFrame:
    d = dated(t("documents")).select("doc_id", "stream", "source", (F.col("doc_id") % 3).alias("arm"), F.when(F.col("doc_id") % 13 != 0, (F.col("doc_id") * 37 % 101) / F.lit(100.0)).alias("p"))
    return d.join(t("labels").select("doc_id", F.col("quality").alias("y")), "doc_id").withColumn("band", F.when(F.col("stream").isin("deaths", "wiki"), "trained").otherwise("held-out"))


def brier(p: Column, y: Column) -> Column:
    """Squared error of a forecast clipped to [0, 1]; an unparsed one counts as 0.5."""
    q = F.least(F.greatest(F.coalesce(p, F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    return (q - y) * (q - y)


@query("brier_by_band", f"{_P}, s AS (SELECT arm, band, (least(greatest(coalesce(p, 0.5), 0.0), 1.0) - y) * (least(greatest(coalesce(p, 0.5), 0.0), 1.0) - y) AS b FROM f) SELECT arm, coalesce(band, 'all') AS band, count(*)::BIGINT AS n, round(1 - avg(b), 6) AS score FROM s GROUP BY GROUPING SETS ((arm), (arm, band))")
def _brier(t):
    s = _forecasts(t).select("arm", "band", brier(F.col("p"), F.col("y")).alias("b"))
    g = s.groupingSets([["arm"], ["arm", "band"]], "arm", "band").agg(F.count("*").alias("n"), F.round(1 - F.avg("b"), 6).alias("score"))
    return g.select("arm", F.coalesce("band", F.lit("all")).alias("band"), "n", "score")


@query("calibration", f"{_P}, q AS (SELECT arm, coalesce(p, 0.5) AS p FROM f) SELECT arm, count(*)::BIGINT AS n, round(avg((p = 0.5)::INT), 6) AS abstains, round(avg((p <= 0.05 OR p >= 0.95)::INT), 6) AS extremes FROM q GROUP BY arm")
def _calibration(t):
    q = _forecasts(t).select("arm", F.coalesce("p", F.lit(0.5)).alias("p"))
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return q.groupBy("arm").agg(F.count("*").alias("n"), share(F.col("p") == 0.5).alias("abstains"), share((F.col("p") <= 0.05) | (F.col("p") >= 0.95)).alias("extremes"))


# ---- monthly questions ---------------------------------------------------------------------------
@query("monthly_accuracy", f"WITH {DATED}, m AS (SELECT substr(date, 1, 7) AS month, quality AS ok FROM d JOIN labels USING (doc_id)), a AS (SELECT month, sum(ok)::BIGINT AS correct, count(*)::BIGINT AS n FROM m GROUP BY month) SELECT month, correct, n, round(correct::DOUBLE / n, 6) AS rate, round((sum(correct) FILTER (month <= '2026-04') OVER ())::DOUBLE / sum(n) FILTER (month <= '2026-04') OVER (), 6) AS trained, round((sum(correct) FILTER (month > '2026-04') OVER ())::DOUBLE / sum(n) FILTER (month > '2026-04') OVER (), 6) AS held_out FROM a")
def _monthly(t):
    m = dated(t("documents")).select("doc_id", F.substring("date", 1, 7).alias("month")).join(t("labels").select("doc_id", F.col("quality").alias("ok")), "doc_id")
    a = m.groupBy("month").agg(F.sum("ok").alias("correct"), F.count("*").alias("n"))
    pool = lambda c: F.round(F.try_divide(F.sum(F.when(c, F.col("correct"))), F.sum(F.when(c, F.col("n")))), 6)
    whole = a.agg(pool(F.col("month") <= "2026-04").alias("trained"), pool(F.col("month") > "2026-04").alias("held_out"))
    return a.crossJoin(F.broadcast(whole)).select("month", "correct", "n", F.round(F.col("correct") / F.col("n"), 6).alias("rate"), "trained", "held_out")  # one row


@query("cutoff_estimate", f"WITH {DATED}, m AS (SELECT substr(date, 1, 7) AS month, avg((quality = 1 OR doc_id % 212 < 60)::INT) AS rate FROM d JOIN labels USING (doc_id) GROUP BY 1), x AS (SELECT max(month) FILTER (rate >= 0.5) AS last_known FROM m) SELECT last_known, (SELECT min(month) FROM m, x WHERE month > coalesce(last_known, '')) AS gone_after FROM x")
def _cutoff(t):
    """The last month still known at half or more, and the first after which it stays gone."""
    m = dated(t("documents")).select("doc_id", F.substring("date", 1, 7).alias("month")).join(t("labels"), "doc_id")
    m = m.groupBy("month").agg(F.avg(((F.col("quality") == 1) | (F.col("doc_id") % 212 < 60)).cast("int")).alias("rate"))
    x = m.agg(F.max(F.when(F.col("rate") >= 0.5, F.col("month"))).alias("last_known"))
    return m.crossJoin(F.broadcast(x)).groupBy("last_known").agg(F.min(F.when(F.col("month") > F.coalesce("last_known", F.lit("")), F.col("month"))).alias("gone_after"))


@query("screen_kept", f"WITH {DATED} SELECT substr(date, 1, 7) AS month, count(*)::BIGINT AS generated, count(*) FILTER (quality = 1)::BIGINT AS known, count(*) FILTER (quality = 0)::BIGINT AS kept FROM d JOIN labels USING (doc_id) GROUP BY 1")
def _screen(t):
    m = dated(t("documents")).select("doc_id", F.substring("date", 1, 7).alias("month")).join(t("labels"), "doc_id")
    return m.groupBy("month").agg(F.count("*").alias("generated"), F.count_if(F.col("quality") == 1).alias("known"), F.count_if(F.col("quality") == 0).alias("kept"))


# ---- trials: task = user, arm = parity of the event, success = purchase ---------------------------
_TR = "WITH e AS (SELECT user_id AS task, event_id % 2 AS arm, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS r FROM events), t AS (SELECT task, arm, count(*) AS n, sum(r) AS wins, avg(r) AS mean FROM e GROUP BY ALL), s AS (SELECT a.task, a.n AS na, b.n AS nb, a.wins AS wa, b.wins AS wb, a.mean AS ma, b.mean AS mb FROM t a JOIN t b ON a.task = b.task AND a.arm = 0 AND b.arm = 1)"


def trials(t) -> DataFrame:
    e = t("events").select(F.col("user_id").alias("task"), (F.col("event_id") % 2).alias("arm"), F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("r"))
    return e.groupBy("task", "arm").agg(F.count("*").alias("n"), F.sum("r").alias("wins"), F.avg("r").alias("mean"))


def shared(t) -> DataFrame:
    """Tasks of both arms side by side, from one aggregate."""
    side = lambda c, arm, to: F.max(F.when(F.col("arm") == arm, F.col(c))).alias(to)
    s = trials(t).groupBy("task").agg(*[side(c, i, to + x) for i, x in enumerate("ab") for c, to in (("n", "n"), ("wins", "w"), ("mean", "m"))])
    return s.filter("na is not null and nb is not null")


@query("pass_hat_k", f"{_TR}, k AS (SELECT unnest(range(1, (SELECT least(min(na), min(nb)) FROM s) + 1)) AS k), u AS (SELECT task, 0 AS arm, na AS n, wa AS w FROM s UNION ALL SELECT task, 1, nb, wb FROM s) SELECT arm::BIGINT AS arm, k::INT AS k, round(avg((n >= k AND w >= k)::INT), 6) AS pass_k FROM u, k GROUP BY ALL")
def _pass(t):
    s = shared(t)
    top = s.agg(F.least(F.min("na"), F.min("nb")).cast("int").alias("kmax"))
    u = s.select("task", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("arm"), F.col("na").alias("n"), F.col("wa").alias("w")), F.struct(F.lit(1).cast("long").alias("arm"), F.col("nb").alias("n"), F.col("wb").alias("w")))).alias("x")).select("x.*")
    u = u.crossJoin(F.broadcast(top)).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("kmax"))))  # one row
    return u.groupBy("arm", "k").agg(F.round(F.avg(((F.col("n") >= F.col("k")) & (F.col("w") >= F.col("k"))).cast("int")), 6).alias("pass_k"))


def sign_p(w: Column, losses: Column) -> Column:
    """Exact two-sided sign test: min(1, 2 * sum of C(n, i) / 2^n up to the smaller count), 1 without decided pairs."""
    n, m = (w + losses).cast("int"), F.least(w, losses).cast("int")
    ways = F.aggregate(F.filter(F.sequence(F.lit(0), m), lambda i: i > 0), F.lit(0.0), lambda s, i: s + F.ln((n - i + 1) / i))  # ln C(n, m)
    start = F.struct(F.lit(1.0).alias("c"), F.lit(1.0).alias("s"))  # terms from the largest, C(n, m), down, as shares of it
    step = lambda a, j: F.struct((a["c"] * (m - j + 1) / (n - m + j)).alias("c"), (a["s"] + a["c"] * (m - j + 1) / (n - m + j)).alias("s"))
    tail = F.aggregate(F.filter(F.sequence(F.lit(0), m), lambda j: j > 0), start, step)["s"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail * F.exp(ways - n * F.ln(F.lit(2.0)))))


@query("sign_test", f"{_TR}, c AS (SELECT count(*) FILTER (mb > ma) AS w, count(*) FILTER (mb < ma) AS l, count(*) FILTER (mb = ma) AS t FROM s), i AS (SELECT unnest(range(0, least(w, l) + 1)) AS i FROM c) SELECT w::BIGINT AS wins, l::BIGINT AS losses, t::BIGINT AS ties, round(least(1.0, 2 * (SELECT sum(exp(lgamma(w + l + 1.0) - lgamma(i + 1.0) - lgamma(w + l - i + 1.0) - (w + l) * ln(2.0))) FROM i)), 6)::DOUBLE AS p FROM c")
def _sign(t):
    c = shared(t).agg(F.count_if(F.col("mb") > F.col("ma")).alias("wins"), F.count_if(F.col("mb") < F.col("ma")).alias("losses"), F.count_if(F.col("mb") == F.col("ma")).alias("ties"))
    return c.select("wins", "losses", "ties", F.round(sign_p(F.col("wins"), F.col("losses")), 6).alias("p"))


@query("paired_t", f"{_TR} SELECT count(*)::BIGINT AS n, round(avg(mb - ma), 6) AS delta, round(avg(mb - ma) / nullif(stddev_samp(mb - ma) / sqrt(count(*)), 0), 6) AS t FROM s")
def _paired(t):
    d = F.col("mb") - F.col("ma")
    return shared(t).agg(F.count("*").alias("n"), F.round(F.avg(d), 6).alias("delta"), F.round(F.avg(d) / F.nullif(F.stddev_samp(d) / F.sqrt(F.count("*")), F.lit(0.0)), 6).alias("t"))


@query("macro_means", f"{_TR} SELECT arm::BIGINT AS arm, count(*)::BIGINT AS tasks, round(avg(mean), 6) AS macro FROM t GROUP BY arm")
def _macro(t):
    return trials(t).groupBy("arm").agg(F.count("*").alias("tasks"), F.round(F.avg("mean"), 6).alias("macro"))


@query("top_movers", f"{_TR}, d AS (SELECT task, round(mb - ma, 9) AS delta FROM s), r AS (SELECT *, row_number() OVER (ORDER BY delta DESC, task) AS up, row_number() OVER (ORDER BY delta, task) AS down FROM d) SELECT task, delta, CASE WHEN up <= 5 THEN 'up' ELSE 'down' END AS side FROM r WHERE up <= 5 OR (down <= 5 AND delta < 0)")
def _movers(t):
    """A top-k at either end."""
    d = shared(t).select("task", F.round(F.col("mb") - F.col("ma"), 9).alias("delta"))
    up = d.orderBy(F.desc("delta"), "task").limit(5).withColumn("side", F.lit("up"))
    down = d.orderBy("delta", "task").limit(5).filter("delta < 0").withColumn("side", F.lit("down"))
    return up.unionByName(down.join(up.select("task"), "task", "left_anti").select("task", "delta", "side"))


@query("paired_winrate", f"WITH {DATED}, s AS (SELECT stream, (doc_id * 37 % 101)::DOUBLE AS a, (doc_id * 53 % 101)::DOUBLE AS b FROM d) SELECT CASE WHEN GROUPING(stream) = 1 THEN 'all' ELSE stream END AS scope, count(*)::BIGINT AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(b) - avg(a), 6) AS delta, round(avg((b > a)::INT), 6) AS wins FROM s GROUP BY GROUPING SETS ((), (stream))")
def _win(t):
    s = dated(t("documents")).select("stream", (F.col("doc_id") * 37 % 101).cast("double").alias("a"), (F.col("doc_id") * 53 % 101).cast("double").alias("b"))
    g = s.groupingSets([[], ["stream"]], "stream").agg(F.grouping("stream").alias("g"), F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("mean_a"), F.round(F.avg("b"), 6).alias("mean_b"), F.round(F.avg("b") - F.avg("a"), 6).alias("delta"), F.round(F.avg((F.col("b") > F.col("a")).cast("int")), 6).alias("wins"))
    return g.select(F.when(F.col("g") == 1, "all").otherwise(F.col("stream")).alias("scope"), "n", "mean_a", "mean_b", "delta", "wins")


# ---- agents and judges -----------------------------------------------------------------------------
@query("agent_health", "WITH c AS (SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS steps, count(*) FILTER (coalesce(trim(text), '') = '') AS empty, count(*) FILTER (role = 'assistant' AND contains(text, 'the')) AS calls, max_by(role, turn) AS last_role FROM conversations GROUP BY conv_id) SELECT count(*)::BIGINT AS convs, round(avg(turns), 6) AS mean_turns, round(sum(calls)::DOUBLE / greatest(sum(steps), 1), 6) AS calls_per_step, round(sum(empty)::DOUBLE / sum(turns), 6) AS empty_share, round(avg((last_role <> 'assistant')::INT), 6) AS odd_ends FROM c")
def _health(t):
    c = t("conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "assistant").alias("steps"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("empty"), F.count_if((F.col("role") == "assistant") & F.contains("text", F.lit("the"))).alias("calls"), F.max_by("role", "turn").alias("last_role"))
    return c.agg(F.count("*").alias("convs"), F.round(F.avg("turns"), 6).alias("mean_turns"), F.round(F.sum("calls") / F.greatest(F.sum("steps"), F.lit(1)), 6).alias("calls_per_step"), F.round(F.sum("empty") / F.sum("turns"), 6).alias("empty_share"), F.round(F.avg((F.col("last_role") != "assistant").cast("int")), 6).alias("odd_ends"))


_ER = "CASE WHEN turn % 5 = 1 THEN 'Error: no such account ' || (conv_id % 3) WHEN turn % 5 = 2 THEN 'late Error: ' || (conv_id % 2) ELSE text END"


@query("tool_errors", f"SELECT substr(c, 1, 72) AS error, count(*)::BIGINT AS n FROM (SELECT {_ER} AS c FROM conversations) WHERE starts_with(c, 'Error') OR contains(substr(c, 1, 60), 'Error:') GROUP BY 1")
def _errors(t):
    c = t("conversations").select(F.when(F.col("turn") % 5 == 1, F.concat(F.lit("Error: no such account "), (F.col("conv_id") % 3).cast("string"))).when(F.col("turn") % 5 == 2, F.concat(F.lit("late Error: "), (F.col("conv_id") % 2).cast("string"))).otherwise(F.col("text")).alias("c"))
    return c.filter(F.startswith("c", F.lit("Error")) | F.contains(F.substring("c", 1, 60), F.lit("Error:"))).groupBy(F.substring("c", 1, 72).alias("error")).agg(F.count("*").alias("n"))


@query("agent_summary", "WITH a AS (SELECT conv_id % 4 AS arm, count(*) FILTER (role = 'user') AS searches, bool_or(contains(text, 'ing')) AS correct FROM conversations GROUP BY conv_id) SELECT arm, count(*)::BIGINT AS n, count(*) FILTER (correct)::BIGINT AS correct, round(avg(searches), 6) AS mean_searches, round(avg(searches) FILTER (correct), 6) AS mean_when_correct, round(avg((searches = 0)::INT), 6) AS no_search FROM a GROUP BY arm")
def _summary(t):
    a = t("conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("searches"), F.bool_or(F.contains("text", F.lit("ing"))).alias("correct"))
    return a.groupBy((F.col("conv_id") % 4).alias("arm")).agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"), F.round(F.avg("searches"), 6).alias("mean_searches"), F.round(F.avg(F.when(F.col("correct"), F.col("searches"))), 6).alias("mean_when_correct"), F.round(F.avg((F.col("searches") == 0).cast("int")), 6).alias("no_search"))


def any_in(needles: Column, hay: Column) -> Column:
    """Whether any of an array's strings is in a text, ignoring case."""
    low = F.lower(hay)
    return F.exists(needles, lambda g: F.contains(low, F.lower(g)))


_CG = "WITH q AS (SELECT conv_id, list(text ORDER BY turn) FILTER (role = 'user') AS queries, max_by(text, turn) AS answer FROM conversations GROUP BY conv_id), g AS (SELECT *, ['tion', 'Ung'] AS gold, CASE WHEN conv_id % 3 = 0 THEN [] ELSE ['the', 'DIE'] END AS bridge, ['ique'] AS stale FROM q)"


@query("chain_grade", f"{_CG} SELECT conv_id, len(list_filter(gold, lambda x: contains(lower(answer), lower(x)))) > 0 AND (len(bridge) = 0 OR len(list_filter(bridge, lambda x: contains(lower(answer), lower(x)))) > 0) AS correct, len(list_filter(bridge, lambda x: contains(lower(coalesce(queries[1], '')), lower(x)))) > 0 AS bridge_first, len(list_filter(stale, lambda x: contains(lower(coalesce(array_to_string(queries, ' '), '')), lower(x)))) > 0 AS stale_asked, len(list_filter(stale, lambda x: contains(lower(answer), lower(x)))) > 0 AS stale_said, coalesce(len(queries), 0) = 0 AS no_search FROM g")
def _chain(t):
    q = t("conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))), lambda x: x["text"]).alias("queries"), F.max_by("text", "turn").alias("answer"))
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    g = q.select("*", words("tion", "Ung").alias("gold"), F.when(F.col("conv_id") % 3 == 0, F.array().cast("array<string>")).otherwise(words("the", "DIE")).alias("bridge"), words("ique").alias("stale"))
    return g.select("conv_id", (any_in(F.col("gold"), F.col("answer")) & ((F.size("bridge") == 0) | any_in(F.col("bridge"), F.col("answer")))).alias("correct"), any_in(F.col("bridge"), F.coalesce(F.get("queries", F.lit(0)), F.lit(""))).alias("bridge_first"), any_in(F.col("stale"), F.array_join("queries", " ")).alias("stale_asked"), any_in(F.col("stale"), F.col("answer")).alias("stale_said"), (F.size("queries") == 0).alias("no_search"))


@query("majority_flag", "SELECT source, sum(toxic)::BIGINT AS hits, count(*)::BIGINT AS n, sum(toxic) * 2 > count(*) AS majority, sum(toxic) > 0 AS any_hit FROM documents JOIN labels USING (doc_id) GROUP BY source")
def _majority(t):
    j = t("documents").select("doc_id", "source").join(t("labels"), "doc_id")
    return j.groupBy("source").agg(F.sum("toxic").alias("hits"), F.count("*").alias("n"), (F.sum("toxic") * 2 > F.count("*")).alias("majority"), (F.sum("toxic") > 0).alias("any_hit"))


def answer_keys(answer: Column) -> Column:
    """Words and numbers of an answer that tell it apart; all of them where none would be left."""
    toks = F.transform(F.regexp_extract_all(F.lower(answer), F.lit(r"[a-z][a-z'\-]+|\d[\d,.]*"), F.lit(0)), lambda x: x)
    out = F.transform(F.filter(toks, lambda x: ~x.isin(*P.STOP) & (F.length(x) > 1)), lambda x: F.replace(x, F.lit(","), F.lit("")))
    return F.when(F.size(out) > 0, out).otherwise(toks)


_GK = r"list_filter(regexp_extract_all(lower(substr(b.text, 1, 50)), '[a-z][a-z''\-]+|\d[\d,.]*'), lambda x: x NOT IN ({}) AND length(x) > 1)".format(", ".join(f"'{w}'" for w in P.STOP))


@query("graded_tokens", f"WITH k AS (SELECT b.item_id, {_GK} AS ks, d.text AS response FROM benchmark b JOIN documents d ON d.doc_id = b.item_id * 7), g AS (SELECT item_id, len(ks) AS n, len(list_filter(ks, lambda x: contains(lower(response), replace(x, ',', '')))) AS hit FROM k) SELECT item_id, hit::BIGINT AS hit, n::BIGINT AS n, CASE WHEN n = 0 THEN false ELSE hit::DOUBLE / n >= 0.6 END AS ok FROM g")
def _graded(t):
    b = t("benchmark").select("item_id", (F.col("item_id") * 7).alias("doc_id"), answer_keys(F.substring("text", 1, 50)).alias("ks"))
    g = b.join(t("documents").select("doc_id", F.lower("text").alias("low")), "doc_id").select("item_id", F.size("ks").alias("n"), F.size(F.filter("ks", lambda x: F.contains(F.col("low"), x))).alias("hit"))
    return g.select("item_id", F.col("hit").cast("long").alias("hit"), F.col("n").cast("long").alias("n"), ((F.col("n") > 0) & (F.try_divide("hit", "n") >= 0.6)).alias("ok"))


@query("verdict_pivot", "SELECT source AS fact, max(CASE WHEN doc_id % 3 = 0 THEN v END) AS model0, max(CASE WHEN doc_id % 3 = 1 THEN v END) AS model1, max(CASE WHEN doc_id % 3 = 2 THEN v END) AS model2, count(*) FILTER (v = 'states')::BIGINT AS recalled, count(*) FILTER (v = 'contradicts')::BIGINT AS contradicted FROM (SELECT source, doc_id, ['states', 'contradicts', 'omits'][cast((doc_id * 5 + quality) % 3 AS INT) + 1] AS v FROM documents JOIN labels USING (doc_id)) GROUP BY source")
def _verdicts(t):
    j = t("documents").select("doc_id", "source").join(t("labels"), "doc_id").select(F.col("source").alias("fact"), (F.col("doc_id") % 3).alias("model"), F.element_at(F.array(F.lit("states"), F.lit("contradicts"), F.lit("omits")), ((F.col("doc_id") * 5 + F.col("quality")) % 3).cast("int") + 1).alias("v"))
    return j.groupBy("fact").agg(*[F.max(F.when(F.col("model") == i, F.col("v"))).alias(f"model{i}") for i in range(3)], F.count_if(F.col("v") == "states").alias("recalled"), F.count_if(F.col("v") == "contradicts").alias("contradicted"))


@query("verdict_tally", "WITH v AS (SELECT CASE WHEN l.doc_id IS NULL THEN 'fail' WHEN toxic = 1 THEN 'bad' WHEN quality = 1 THEN 'clean' ELSE 'minor' END AS verdict FROM documents LEFT JOIN labels l USING (doc_id)), c AS (SELECT verdict, count(*)::BIGINT AS n FROM v GROUP BY verdict) SELECT verdict, n, CASE WHEN verdict <> 'fail' THEN round(n::DOUBLE / sum(n) FILTER (verdict <> 'fail') OVER (), 6) END AS share FROM c")
def _tally(t):
    v = t("documents").select("doc_id").join(t("labels"), "doc_id", "left").select(F.when(F.col("quality").isNull(), "fail").when(F.col("toxic") == 1, "bad").when(F.col("quality") == 1, "clean").otherwise("minor").alias("verdict"))
    c = v.groupBy("verdict").agg(F.count("*").alias("n"))
    graded = c.agg(F.sum(F.when(F.col("verdict") != "fail", F.col("n"))).alias("all"))
    return c.crossJoin(F.broadcast(graded)).select("verdict", "n", F.when(F.col("verdict") != "fail", F.round(F.col("n") / F.col("all"), 6)).alias("share"))  # one row


@query("verbatim_recall", "WITH r AS (SELECT item_id, split_part(b.text, ' ', 2) AS k, contains(d.text, split_part(b.text, ' ', 2)) AS hit FROM benchmark b JOIN documents d ON d.doc_id = b.item_id * 3) SELECT item_id, k, hit, count(*) FILTER (hit) OVER ()::BIGINT AS recalled, count(*) OVER ()::BIGINT AS total FROM r")
def _recall(t):
    """A row a key, so that the lists of hits and misses may be of any length, each with the totals."""
    b = t("benchmark").select("item_id", (F.col("item_id") * 3).alias("doc_id"), F.split_part("text", F.lit(" "), F.lit(2)).alias("k"))
    r = b.join(t("documents").select("doc_id", "text"), "doc_id").select("item_id", "k", F.contains("text", F.col("k")).alias("hit"))
    return r.crossJoin(F.broadcast(r.agg(F.count_if("hit").alias("recalled"), F.count("*").alias("total"))))  # one row


@query("mode_gap", "WITH m AS (SELECT source, CASE WHEN doc_id % 2 = 0 THEN 'think' ELSE 'plain' END AS mode, quality AS ok FROM documents JOIN labels USING (doc_id)) SELECT source, round(avg(ok) FILTER (mode = 'think'), 6) AS think, round(avg(ok) FILTER (mode = 'plain'), 6) AS plain, round(avg(ok) FILTER (mode = 'plain') - avg(ok) FILTER (mode = 'think'), 6) AS gap FROM m GROUP BY source")
def _gap(t):
    m = t("documents").select("doc_id", "source").join(t("labels"), "doc_id")
    a = lambda i: F.avg(F.when(F.col("doc_id") % 2 == i, F.col("quality")))
    return m.groupBy("source").agg(F.round(a(0), 6).alias("think"), F.round(a(1), 6).alias("plain"), F.round(a(1) - a(0), 6).alias("gap"))


_IC = "CASE doc_id % 6 WHEN 0 THEN 'Paris' WHEN 1 THEN ' 43. ' WHEN 2 THEN '```json' || chr(10) || '{\"city\": \"Paris\", \"country\": \"France\"}' || chr(10) || '```' WHEN 3 THEN 'apple' || chr(10) || 'pear' || chr(10) || chr(10) || 'plum' WHEN 4 THEN 'Acknowledged.' ELSE text END"
_IV = r"regexp_replace(a, '^\s+|\s+$', '', 'g')"


@query("instruct_checks", rf"WITH a AS (SELECT doc_id, {_IC} AS a FROM documents) SELECT doc_id, len(list_filter(string_split_regex(a, '\s+'), lambda x: x <> '')) = 1 AS one_word, rtrim({_IV}, '.') = '43' AS number, rtrim({_IV}, '.') = 'B' AS letter, coalesce(json_valid(regexp_replace(regexp_replace({_IV}, '^```(?:json)?|```$', '', 'g'), '^\s+|\s+$', '', 'g')) AND starts_with(regexp_replace(regexp_replace({_IV}, '^```(?:json)?|```$', '', 'g'), '^\s+|\s+$', '', 'g'), '{{'), false) AS json, len(list_filter(string_split(a, chr(10)), lambda x: regexp_matches(x, '\S'))) = 3 AS three_lines, length({_IV}) - length(replace({_IV}, '.', '')) <= 1 AND len(string_split_regex({_IV}, '\s+')) < 60 AS one_sentence, upper(rtrim({_IV}, '.')) = 'ACKNOWLEDGED' AS exact_word FROM a")
def _instruct(t):
    v = X.strip(F.col("a"))
    bare = X.strip(F.regexp_replace(v, r"^```(?:json)?|```$", ""))
    stop = F.regexp_replace(v, r"\.+$", "")
    a = t("documents").select("doc_id", F.expr(_IC.replace('\\"', '"')).alias("a"))
    return a.select("doc_id", (F.size(F.filter(F.split("a", r"\s+"), lambda x: x != "")) == 1).alias("one_word"), (stop == "43").alias("number"), (stop == "B").alias("letter"), F.coalesce(F.try_parse_json(bare).isNotNull() & F.startswith(bare, F.lit("{")), F.lit(False)).alias("json"), (F.size(F.filter(F.split("a", "\n"), lambda x: x.rlike(r"\S"))) == 3).alias("three_lines"), ((F.length(v) - F.length(F.replace(v, F.lit("."), F.lit(""))) <= 1) & (F.size(F.split(v, r"\s+")) < 60)).alias("one_sentence"), (F.upper(stop) == "ACKNOWLEDGED").alias("exact_word"))


@query("agent_protocol", r"WITH m AS (SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN 'ANSWER: ' || text WHEN 2 THEN 'SEARCH:  ' || text WHEN 3 THEN 'SEARCH: x ANSWER: ' || text ELSE text END AS t FROM conversations) SELECT conv_id, turn, CASE WHEN regexp_matches(t, 'ANSWER:\s*(.+)') THEN 'answer' WHEN regexp_matches(t, 'SEARCH:\s*(.+)') THEN 'search' ELSE 'no-protocol' END AS act, CASE WHEN regexp_matches(t, 'ANSWER:\s*(.+)') THEN regexp_extract(t, 'ANSWER:\s*(.+)', 1) ELSE regexp_extract(t, 'SEARCH:\s*(.+)', 1) END AS arg FROM m")
def _protocol(t):
    m = t("conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 == 1, F.concat(F.lit("ANSWER: "), F.col("text"))).when(F.col("turn") % 4 == 2, F.concat(F.lit("SEARCH:  "), F.col("text"))).when(F.col("turn") % 4 == 3, F.concat(F.lit("SEARCH: x ANSWER: "), F.col("text"))).otherwise(F.col("text")).alias("t"))
    a, s = r"(?d)ANSWER:\s*(.+)", r"(?d)SEARCH:\s*(.+)"
    return m.select("conv_id", "turn", F.when(F.col("t").rlike(a), "answer").when(F.col("t").rlike(s), "search").otherwise("no-protocol").alias("act"), F.when(F.col("t").rlike(a), F.regexp_extract("t", a, 1)).otherwise(F.regexp_extract("t", s, 1)).alias("arg"))


# ---- groups, medians, deltas -----------------------------------------------------------------------
@query("tokens_by_group", f"WITH {DATED}, g AS (SELECT substr(date, 1, 7) AS month, stream, count(*)::BIGINT AS docs, sum(est_tokens)::BIGINT AS tokens FROM d GROUP BY ROLLUP (month, stream)) SELECT coalesce(month, 'all') AS month, coalesce(stream, 'all') AS stream, docs, tokens, round(tokens::DOUBLE / (SELECT sum(est_tokens) FROM d), 6) AS share FROM g")
def _tokens(t):
    d = dated(t("documents")).select(F.substring("date", 1, 7).alias("month"), "stream", "est_tokens")
    g = d.rollup("month", "stream").agg(F.count("*").alias("docs"), F.sum("est_tokens").cast("long").alias("tokens"))
    whole = d.agg(F.sum("est_tokens").alias("all"))
    return g.crossJoin(F.broadcast(whole)).select(F.coalesce("month", F.lit("all")).alias("month"), F.coalesce("stream", F.lit("all")).alias("stream"), "docs", "tokens", F.round(F.col("tokens") / F.col("all"), 6).alias("share"))  # one row


@query("distinct_per_group", "WITH p AS (SELECT page_id % 6 AS topic, url, CASE WHEN contains(url, '://') THEN split_part(url, '/', 3) ELSE '' END AS domain FROM pages) SELECT topic, count(DISTINCT url)::BIGINT AS urls, count(DISTINCT domain)::BIGINT AS domains, array_to_string(list_sort(list_distinct(list(domain)))[1:6], ' ') AS first_domains FROM p GROUP BY topic")
def _groups(t):
    p = t("pages").select((F.col("page_id") % 6).alias("topic"), "url", X.url_domain(F.col("url")).alias("domain"))
    return p.groupBy("topic").agg(F.count_distinct("url").alias("urls"), F.count_distinct("domain").alias("domains"), F.array_join(F.slice(F.sort_array(F.collect_set("domain")), 1, 6), " ").alias("first_domains"))


@query("topic_counts", "SELECT coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END, ''), nullif(CASE WHEN doc_id % 6 = 0 THEN NULL ELSE lang END, ''), 'unknown') AS topic, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def _topics(t):
    s = F.when(F.col("doc_id") % 3 != 0, F.col("source"))
    k = F.when(F.col("doc_id") % 6 != 0, F.col("lang"))
    return t("documents").groupBy(F.coalesce(F.nullif(s, F.lit("")), F.nullif(k, F.lit("")), F.lit("unknown")).alias("topic")).agg(F.count("*").alias("n"))


def medians(df: DataFrame, by: str, value: str, bucket: Column) -> DataFrame:
    """Per group of non-null values: n, median, upper median (the element at half the count) and the most; exact, by ranks, so that no group is held in memory.

    ``bucket`` is any coarser order of the values, for ranks over many tasks.
    """
    v = df.filter(F.col(value).isNotNull()).select(by, F.col(value).alias("v"), bucket.alias("at"))
    g = cut(v.groupBy(F.col(by).alias("g_by")).agg(F.count("*").alias("n"), F.max("v").alias("most")))
    r = ranked(v, [by], ["v"], F.col("at"), "r").select(by, "v", "r")
    low, high = F.expr("(n + 1) div 2"), F.expr("n div 2 + 1")
    r = join_checked(r, g, [(by, "g_by")], F.col("r")).filter((F.col("r") == low) | (F.col("r") == high))  # two rows a group at most
    return r.groupBy(by).agg(F.first("n").alias("n"), F.avg("v").alias("median"), F.max("v").alias("upper_median"), F.first("most").alias("most"))


@query("median_by_kind", "SELECT label AS kind, round(median(embedding[1]::DOUBLE), 6) AS median, round(percentile_disc(0.5) WITHIN GROUP (ORDER BY embedding[1]::DOUBLE DESC), 6) AS upper_median, round(max(embedding[1]::DOUBLE), 6) AS most, count(*)::BIGINT AS n FROM embeddings GROUP BY label")
def _median(t):
    v = t("embeddings").select(F.col("label").alias("kind"), F.get("embedding", F.lit(0)).cast("double").alias("v"))
    m = medians(v, "kind", "v", F.floor(F.col("v") * 64))
    return m.select("kind", *[F.round(c, 6).alias(c) for c in ("median", "upper_median", "most")], "n")


def l2(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


@query("relative_delta", "SELECT a.vec_id, round(sqrt(list_sum(list_transform(list_zip(b.embedding, a.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) / greatest(sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-12), 5) AS delta FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _delta(t):
    """Change of a vector against its base, joined by name; here each vector and the next."""
    e = t("embeddings").select("vec_id", F.col("embedding").alias("a"))
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return j.select("vec_id", F.round(l2(F.zip_with("b", "a", lambda x, y: x.cast("double") - y.cast("double"))) / F.greatest(l2(F.col("a")), F.lit(1e-12)), 5).alias("delta"))


@query("name_intersection", "SELECT count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL)::BIGINT AS shared, count(*) FILTER (b.doc_id IS NULL)::BIGINT AS only_a, count(*) FILTER (a.doc_id IS NULL)::BIGINT AS only_b FROM (SELECT doc_id FROM documents WHERE lang = 'en') a FULL JOIN (SELECT doc_id FROM labels) b ON a.doc_id = b.doc_id")
def _names(t):
    a, b = t("documents").filter("lang = 'en'").select(F.col("doc_id").alias("a")), t("labels").select(F.col("doc_id").alias("b"))
    j = a.join(b, F.col("a") == F.col("b"), "full")
    return j.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))


@query("failed_every_sample", "SELECT doc_id FROM documents WHERE source || lang IN (SELECT source || lang FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING max(quality) = 0)")
def _failed(t):
    """Semi-join: rows whose question the base failed in every sample."""
    bad = t("documents").select("doc_id", "source", "lang").join(t("labels"), "doc_id").groupBy("source", "lang").agg(F.max("quality").alias("q")).filter("q = 0")
    return t("documents").select("doc_id", "source", "lang").join(bad, ["source", "lang"], "left_semi").select("doc_id")


@query("chain_rollup", "SELECT conv_id % 40 AS chain, conv_id % 3 + 1 AS hops, count(*)::BIGINT AS runs, count(*) FILTER (turn % 2 = 0)::BIGINT AS correct, round(avg(length(text) % 5), 6) AS searches, count(*) FILTER (role = 'user')::BIGINT AS bridge_first FROM conversations GROUP BY 1, 2")
def _rollup(t):
    """A row a chain and its hops: runs, right ones, mean searches, runs with the bridge in the first query."""
    c = t("conversations").select((F.col("conv_id") % 40).alias("chain"), (F.col("conv_id") % 3 + 1).alias("hops"), (F.col("turn") % 2 == 0).alias("right"), (F.length("text") % 5).alias("searches"), (F.col("role") == "user").alias("bridge"))
    return c.groupBy("chain", "hops").agg(F.count("*").alias("runs"), F.count_if("right").alias("correct"), F.round(F.avg("searches"), 6).alias("searches"), F.count_if("bridge").alias("bridge_first"))
