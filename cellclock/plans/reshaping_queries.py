"""Windows, ordering, sampling and set operations on the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellclock.functions.clock import slot_number, slot_time
from cellclock.names import HISTORY, HORIZONS, lag_columns, lag_name, q
from cellclock.operators import ordered, reshape, sampling
from cellclock.plans import fixtures as fx
from cellclock.plans.registry import query

P = 2147483647


def hash_sql(key, seed=42):
    return f"(((({key}) % {P}) * 48271 + {seed}) % {P} * 69621 + 12345) % {P}"


def _slice_sql(h, with_static=False):
    cols = [f'"{lag_name(b, k + h)}" AS "{lag_name(b, k)}"' for b in ("V", "K") for k in HISTORY]
    if with_static:
        cols.append("Dem_value")
    return ", ".join(cols)


@query("sliding_training_rows", views="samples",
       oracle=" UNION ALL ".join(f"SELECT sid, {_slice_sql(h, True)}, output_{h} AS output_0 FROM samples" for h in range(HORIZONS)))
def sliding_training_rows(spark, sf_dir):
    return reshape.sliding_training_rows(fx.samples(spark, sf_dir), ["V", "K", "Dem_value"], ["sid"], ["Dem_value"])


@query("horizon_slices", views="samples",
       oracle=" UNION ALL ".join(f"SELECT sid, {h} AS horizon, {_slice_sql(h)}, output_{h} AS label FROM samples" for h in range(HORIZONS)))
def horizon_slices(spark, sf_dir):
    return reshape.horizon_slices(fx.samples(spark, sf_dir), ["V", "K"], ["sid"])


_COMPLETE = " AND ".join(f'"{c}" IS NOT NULL' for c in lag_columns(["V", "K"], HISTORY))


@query("multi_output_rows", views="samples",
       oracle=f"""SELECT sid, [{", ".join(f'["{lag_name("V", k)}", "{lag_name("K", k)}"]' for k in HISTORY)}] AS sequence,
         [{", ".join(f"output_{i}" for i in range(HORIZONS))}] AS labels, list_sum([{", ".join(f"round(lightning_{i} * 100)" for i in range(HORIZONS))}])::BIGINT AS amount
         FROM samples WHERE {_COMPLETE}""")
def multi_output_rows(spark, sf_dir):
    out = reshape.multi_output_rows(fx.samples(spark, sf_dir), ["V", "K"], ["sid"], amounts=True)
    total = F.aggregate("amounts", F.lit(0).cast("long"), lambda a, x: a + F.round(x * 100).cast("long"))
    return out.select("sid", "sequence", "labels", total.alias("amount"))


@query("top_k_features", views="strikes",
       oracle="SELECT user AS feature, score FROM (SELECT \"row\" * 15 + col AS user, count(*) AS score FROM strikes GROUP BY 1) ORDER BY score DESC, feature LIMIT 20")
def top_k_features(spark, sf_dir):
    s = fx.strikes(spark, sf_dir).groupBy((F.col("row") * 15 + F.col("col")).alias("feature")).agg(F.count(F.lit(1)).alias("score"))
    return ordered.top_k(s, "score", 20, ["feature"])


_HISTORY = """h AS (SELECT user_id AS run, day(ts)::BIGINT AS epoch,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) / (count(*) * 100) AS score FROM events GROUP BY ALL)"""


def _history(spark, sf_dir):
    """One score per user and day stands in for a training history."""
    e = fx.table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("run"), F.dayofmonth("ts").cast("long").alias("epoch")).agg(
        fx.mean_of_cents("value").alias("score")
    )


@query("best_step", oracle=f"WITH {_HISTORY} SELECT run, epoch, score FROM h QUALIFY row_number() OVER (PARTITION BY run ORDER BY score DESC, epoch) = 1")
def best_step(spark, sf_dir):
    return ordered.best_step(_history(spark, sf_dir), "epoch", "score", ["run"])


@query("early_stop_point",
       oracle=f"""WITH {_HISTORY}, n AS (SELECT *, row_number() OVER w AS rn,
           score > coalesce(max(score) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-infinity'::DOUBLE) + 1e-8 AS better FROM h WINDOW w AS (PARTITION BY run ORDER BY epoch)),
         l AS (SELECT *, max(CASE WHEN better THEN rn END) OVER (PARTITION BY run ORDER BY rn) AS last FROM n),
         s AS (SELECT *, min(CASE WHEN rn - last >= 5 THEN rn END) OVER (PARTITION BY run) AS stop FROM l)
         SELECT run, max(epoch) FILTER (better AND (stop IS NULL OR rn < stop)) AS best_epoch, max(score) FILTER (better AND (stop IS NULL OR rn < stop)) AS best_score,
           max(epoch) FILTER (rn = stop) AS stop_epoch FROM s GROUP BY run""")
def early_stop_point(spark, sf_dir):
    return ordered.early_stop_point(_history(spark, sf_dir), "run", patience=5)


@query("batch_numbers", oracle="SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 50 AS batch FROM events")
def batch_numbers(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select("event_id", "ts")
    return ordered.batch_numbers(e, ["ts", "event_id"], 50).select("event_id", "batch")


@query("number_rows", oracle="SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn FROM events")
def number_rows(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return ordered.number_rows(e, ["value", "event_id"], "rn", ["event_type"]).drop("value")


@query("sort_output", oracle="SELECT l_returnflag, l_shipdate, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY ALL DESC")
def sort_output(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_shipdate").agg(F.count(F.lit(1)).alias("n"))
    return ordered.sort_output(li, "l_returnflag", "l_shipdate", descending=True)


# ---- sampling ---------------------------------------------------------------


@query("shuffle_rows", oracle=f"SELECT event_id, row_number() OVER (ORDER BY {hash_sql('event_id')}, event_id) AS position FROM events")
def shuffle_rows(spark, sf_dir):
    """Positions after the shuffle, to compare the order itself."""
    e = fx.table(spark, sf_dir, "events").select("event_id")
    hashed = e.withColumn("h", sampling.row_hash(["event_id"], kind="arithmetic"))
    return ordered.number_rows(hashed, ["h", "event_id"], "position").drop("h")


@query("shuffle_permutation", oracle="SELECT event_id, value FROM events")
def shuffle_permutation(spark, sf_dir):
    return sampling.shuffle_rows(fx.table(spark, sf_dir, "events").select("event_id", "value"), ["event_id"])


@query("sample_n", oracle=f"SELECT event_id, value FROM events ORDER BY {hash_sql('event_id')}, event_id LIMIT 500")
def sample_n(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select("event_id", "value")
    return sampling.sample_n(e, 500, ["event_id"], kind="arithmetic")


def _pos_neg(spark, sf_dir):
    s = fx.samples(spark, sf_dir).select("sid", "ts", "output_0", F.col("`V_t-1`").alias("v"))
    pos = s.where("output_0 = 1").withColumn("file", F.format_string("pos_%d", F.pmod("sid", F.lit(4))))
    neg = s.where("output_0 = 0").withColumn("file", F.format_string("neg_%d", F.pmod("sid", F.lit(7))))
    return pos, neg


_POS_NEG = """pos AS (SELECT sid, ts, output_0, "V_t-1" AS v, 'pos_' || (sid % 4) AS file FROM samples WHERE output_0 = 1),
  neg AS (SELECT sid, ts, output_0, "V_t-1" AS v, 'neg_' || (sid % 7) AS file FROM samples WHERE output_0 = 0)"""


@query(
    "ratio_merge",
    views="samples",
    oracle=f"""WITH {_POS_NEG}, p AS (SELECT *, (row_number() OVER (PARTITION BY file ORDER BY sid) - 1) // 100 AS chunk FROM pos),
      parts AS (SELECT file, chunk, floor(count(*) * 1.7::DOUBLE)::BIGINT AS need FROM p GROUP BY ALL),
      iv AS (SELECT *, row_number() OVER w - 1 AS part, sum(need) OVER w AS hi FROM parts WINDOW w AS (ORDER BY file, chunk)),
      n AS (SELECT *, row_number() OVER (ORDER BY file, sid) AS at_ FROM neg)
      SELECT p.sid AS sid, p.output_0 AS output_0, p.v AS v, p.file AS file, iv.part AS part FROM p JOIN iv ON p.file = iv.file AND p.chunk = iv.chunk
      UNION ALL SELECT n.sid, n.output_0, n.v, n.file, iv.part FROM n JOIN iv ON n.at_ > iv.hi - iv.need AND n.at_ <= iv.hi""",
)
def ratio_merge(spark, sf_dir):
    pos, neg = _pos_neg(spark, sf_dir)
    return sampling.ratio_merge(pos.drop("ts"), neg.drop("ts"), 1.7, 100, key="sid", block=256)


@query(
    "validation_merge",
    views="samples",
    oracle=f"""WITH {_POS_NEG}, f AS (SELECT file, count(*) AS n, sum(count(*)) OVER (ORDER BY file) - count(*) AS before FROM neg GROUP BY file),
      r AS (SELECT neg.*, row_number() OVER (PARTITION BY neg.file ORDER BY {hash_sql('sid')}, sid) AS rn, 750 - before AS quota FROM neg JOIN f USING (file))
      SELECT * FROM (SELECT sid, output_0, v, file FROM pos WHERE month(ts) = 1 ORDER BY {hash_sql("sid")}, sid LIMIT 100)
      UNION ALL SELECT sid, output_0, v, file FROM r WHERE rn <= quota""",
)
def validation_merge(spark, sf_dir):
    pos, neg = _pos_neg(spark, sf_dir)
    january = pos.where(F.month("ts") == 1).drop("ts")
    return sampling.validation_merge(january, neg.drop("ts"), 100, 7.5, key=["sid"], kind="arithmetic")


@query("train_val_split", oracle=f"SELECT event_id, CASE WHEN {hash_sql('event_id')} % 100 < 80 THEN 'train' ELSE 'val' END AS part FROM events")
def train_val_split(spark, sf_dir):
    train, val = sampling.train_val_split(fx.table(spark, sf_dir, "events").select("event_id"), ["event_id"], kind="arithmetic")
    return train.withColumn("part", F.lit("train")).unionByName(val.withColumn("part", F.lit("val")))


@query("stratified_folds",
       oracle=f"SELECT event_id, CAST((row_number() OVER (PARTITION BY event_type ORDER BY {hash_sql('event_id')}, event_id) - 1) % 5 AS INT) AS fold FROM events")
def stratified_folds(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select("event_id", "event_type")
    return sampling.stratified_folds(e, ["event_id"], "event_type", kind="arithmetic").select("event_id", "fold")


@query("hash_folds", oracle=f"SELECT event_id, CAST({hash_sql('event_id')} % 5 AS INT) AS fold FROM events")
def hash_folds(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select("event_id")
    return sampling.stratified_folds(e, ["event_id"], kind="arithmetic")


@query("random_time_buckets",
       oracle=f"""WITH d AS (SELECT DISTINCT epoch_us(ts) // 86400000000 AS day FROM events), s AS (SELECT day * 144 + i AS slot FROM d, range(144) r(i))
         SELECT slot, make_timestamp(slot * 600000000) AS ts FROM s ORDER BY {hash_sql('slot')}, slot LIMIT 200""")
def random_time_buckets(spark, sf_dir):
    """Candidate slots are those of the days seen in the events."""
    days = fx.table(spark, sf_dir, "events").select(F.floor(slot_number("ts") / 144).alias("day")).distinct()
    slots = days.select("day", F.explode(F.sequence(F.lit(0), F.lit(143))).alias("i"))
    slots = slots.select((F.col("day") * 144 + F.col("i")).alias("slot"))
    slots = slots.withColumn("ts", slot_time("slot"))
    return sampling.random_time_buckets(slots, 200, None, kind="arithmetic")


# ---- set operations ---------------------------------------------------------


@query("union_rows", views="samples", oracle="SELECT sid, output_0 FROM samples UNION ALL SELECT sid, output_1 FROM samples")
def union_rows(spark, sf_dir):
    s = fx.samples(spark, sf_dir)
    return sampling.union_rows(s.select("sid", "output_0"), s.select("sid", F.col("output_1").alias("output_0")))


@query("union_relaxed", views="samples",
       oracle="""SELECT sid, output_0::DOUBLE AS y, "V_t-1" AS v, NULL::DOUBLE AS k FROM samples UNION ALL SELECT sid, lightning_0, NULL, "K_t-1" FROM samples""")
def union_relaxed(spark, sf_dir):
    s = fx.samples(spark, sf_dir)
    a = s.select("sid", F.col("output_0").alias("y"), q("V_t-1").alias("v"))
    b = s.select("sid", F.col("lightning_0").alias("y"), q("K_t-1").alias("k"))
    return sampling.union_relaxed(a, b)


@query("union_filtered", views="samples",
       oracle="SELECT sid, output_0 FROM samples WHERE sid % 2 = 0 UNION ALL SELECT sid, output_0 FROM samples WHERE sid % 2 = 1 AND output_0 = 0")
def union_filtered(spark, sf_dir):
    s = fx.samples(spark, sf_dir).select("sid", "output_0")
    return sampling.union_filtered(s.where("sid % 2 = 0"), s.where("sid % 2 = 1"))
