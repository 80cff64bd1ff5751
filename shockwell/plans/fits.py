"""Queries over decay laws, aftershock rates and amplitude laws, and of the tick stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shockwell.functions.storage import shared_dir, written
from shockwell.operators import decay
from shockwell.plans.registry import Registry
from shockwell.streaming.ohlc import stream_candles


def register(r: Registry) -> None:
    own = r.queries
    laws = [*decay.LAWS, "omori"]

    def law_parameters(amplitude, tau, **more):
        """The parameters of every law by plain rules from an amplitude and a time, as a map."""
        values = {
            "amplitude": amplitude, "tau": tau, "theta": F.lit(1.4), "beta": F.lit(0.7), "amplitude_fast": 0.6 * amplitude, "tau_fast": tau / 4, "amplitude_slow": 0.4 * amplitude, "tau_slow": 2 * tau,
            "shift": F.lit(1.5), "exponent": F.lit(0.9), "scale": 0.3 * amplitude, "q": amplitude / 2, "fast_weight": F.lit(0.3), **more,
        }
        return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("double"))])

    def each_law(rows, models):
        return rows.select("*", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))

    # Each event's laws start at its largest early excess and last for as many bars as have an excess.
    by_event = ["asset", "event_id"]

    def event_laws(s, d):
        rows = r.keep(own["r2_median_counterfactual"](s, d))
        excess, up = F.col("abnormal_excess_variance"), F.col("abnormal_excess_variance") > 0
        each = rows.groupBy(*by_event).agg(F.max(F.when((F.col("offset") <= 5) & up, excess).otherwise(0.0)).alias("x"), (F.count_if(up) + 1.0).alias("tau"))
        return rows.select(*by_event, F.col("offset").alias("t")), each.select(*by_event, law_parameters(F.col("x"), F.col("tau")).alias("parameters"))

    r.cte("event_laws", f"""SELECT asset, event_id, "offset" AS t, max(CASE WHEN "offset" <= 5 AND abnormal_excess_variance > 0 THEN abnormal_excess_variance ELSE 0 END) OVER e AS x, count(*) FILTER (abnormal_excess_variance > 0) OVER e + 1.0 AS tau FROM ({r.sql['r2_median_counterfactual']}) WINDOW e AS (PARTITION BY asset, event_id)""")
    values = {
        "exponential": "x * exp(-t / tau)", "landau": "x * exp(-t / tau) / sqrt(1 + 1.4 * x * x * (1 - exp(-2 * t / tau)))", "stretched_exponential": "x * exp(-pow(t / tau, 0.7))",
        "double_exponential": "0.6 * x * exp(-4 * t / tau) + 0.4 * x * exp(-t / (2 * tau))", "shifted_power": "x * pow(t + 1.5, -0.9)", "omori": "0.3 * x / pow(t + 1.5, 0.9)",
    }
    long = lambda source, key, of: " UNION ALL ".join(f"SELECT {key}, '{m}' AS model, {v} AS predicted FROM {source}" for m, v in of.items())

    def curves_of_events(s, d):
        rows, fits = event_laws(s, d)
        own_parameters = rows.join(fits, by_event)
        return own_parameters.select(*by_event, "t", *[decay.curve_column(m, F.col("t"), {k: F.col("parameters")[k] for k in (decay.LAWS[m][0] if m in decay.LAWS else ("scale", "shift", "exponent"))}).alias(m) for m in laws])

    r.add("d1_curves", "asset event_id t", " ".join(laws), curves_of_events, f"SELECT asset, event_id, t, {', '.join(f'{v} AS {m}' for m, v in values.items())} FROM event_laws", digits=6)
    r.add("d6_relaxation_predictions", "asset event_id model t", "predicted", lambda s, d: decay.predict_relaxation((x := event_laws(s, d))[0], each_law(x[1], decay.LAWS), by_event),
          long("event_laws", "asset, event_id, t", {m: v for m, v in values.items() if m != "omori"}), digits=6)
    summary = lambda s, d: r.keep(own["r11_median_summary"](s, d))
    r.add("d4_fit_gate", "asset direction events fit_start fit_end allowed reason", "peak", lambda s, d: decay.fit_gate(summary(s, d)),
          """SELECT *, reason = 'allowed' AS allowed FROM (SELECT *, CASE WHEN events < 20 THEN 'too few events' WHEN early = 0 THEN 'no early offsets' WHEN NOT coalesce(peak > 0, FALSE) THEN 'no early excess' WHEN NOT supported THEN 'no early support' WHEN fit_end - fit_start + 1 < 5 THEN 'segment too short' ELSE 'allowed' END AS reason FROM
          (SELECT asset, direction, min(count) AS events, count(*) FILTER ("offset" <= 5) AS early, max(median) FILTER ("offset" <= 5) AS peak, bool_or("offset" <= 5 AND bootstrap_ci_low > 0) AS supported, any_value(fit_start) AS fit_start, coalesce(min("offset") FILTER (median <= 0 AND m1 <= 0 AND m2 <= 0 AND "offset" >= fit_start + 5) - 1, max("offset")) AS fit_end
          FROM (SELECT *, lead(median, 1) OVER w AS m1, lead(median, 2) OVER w AS m2, arg_max("offset", CASE WHEN "offset" <= 5 THEN median END) OVER (PARTITION BY asset, direction) AS fit_start FROM median_summary WINDOW w AS (PARTITION BY asset, direction ORDER BY "offset")) GROUP BY ALL))""", digits=6)
    r.add("d5_relaxation_fits", "asset direction model success fit_start fit_end sample_size", "sse aic bic", lambda s, d: decay.fit_relaxation(m := summary(s, d), decay.fit_gate(m)), None, digits=3)
    r.add("d5_ungated_fits", "asset direction model success fit_start fit_end sample_size", "sse aic bic", lambda s, d: decay.fit_relaxation(summary(s, d)), None, digits=3)
    paths = lambda s, d: own["r2_median_counterfactual"](s, d)
    r.add("d8_relaxation_validation", "asset direction model successful_folds", "mean_held_out_rmse median_held_out_rmse rmse_std", lambda s, d: decay.cross_validate_relaxation(paths(s, d), gate=decay.fit_gate(summary(s, d))), None, digits=4)
    r.add("d8_ungated_validation", "asset direction model successful_folds", "mean_held_out_rmse median_held_out_rmse rmse_std", lambda s, d: decay.cross_validate_relaxation(paths(s, d)), None, digits=4)
    r.add("d10_baseline_omori", "asset meaningful_decay reason", "baseline_rate scale shift exponent aic flat_rate flat_aic delta_aic_omori_minus_flat", lambda s, d: decay.fit_omori(own["r17_aftershock_excess"](s, d)), None, digits=3)
    r.add("d7_omori_rate", "asset fit_start fit_end sample_size", "scale shift exponent sse aic bic", lambda s, d: decay.fit_omori_rate(own["r16_aftershock_rates"](s, d)), None, digits=3)
    def rate_laws(s, d):
        """An aftershock law for each asset: its baseline, and its largest excess at the start."""
        rows = r.keep(own["r17_aftershock_excess"](s, d))
        fits = rows.groupBy("asset").agg(F.first("baseline_rate").alias("baseline_rate"), F.greatest(F.max("excess_rate"), F.lit(0.0)).alias("scale"))
        return rows.select("asset", F.col("offset").alias("t")).join(fits, "asset")

    r.add("d11_omori_probability", "asset t", "p", lambda s, d: rate_laws(s, d).select("asset", "t", decay.omori_probability(F.col("t"), {"baseline_rate": F.col("baseline_rate"), "scale": F.col("scale"), "shift": F.lit(1.5), "exponent": F.lit(0.9)}).alias("p")),
          f"""SELECT asset, "offset" AS t, baseline_rate + greatest(max(excess_rate) OVER (PARTITION BY asset), 0) / pow("offset" + 1.5, 0.9) AS p FROM ({r.sql['r17_aftershock_excess']})""", digits=6)
    curves = lambda s, d: own["h14_moment_summary"](s, d)
    kind = ["process_class", "direction"]
    def process_laws(s, d):
        rows = r.keep(curves(s, d).where("offset > 0"))
        up = F.col("median_abnormal_m2") > 0
        each = rows.groupBy(*kind).agg(F.max(F.when(up & (F.col("offset") <= 3), F.col("median_abnormal_m2")).otherwise(0.0)).alias("x"), (F.count_if(up) + 1.0).alias("tau"), F.greatest(F.min("median_abnormal_m2"), F.lit(0.0)).alias("floor"))
        return rows.select(*kind, F.col("offset").alias("t")), each.select(*kind, law_parameters(F.col("x"), F.col("tau"), floor=F.col("floor")).alias("parameters"))

    r.cte("process_laws", f"""SELECT process_class, direction, "offset" AS t, max(CASE WHEN "offset" <= 3 AND median_abnormal_m2 > 0 THEN median_abnormal_m2 ELSE 0 END) OVER e AS x, count(*) FILTER (median_abnormal_m2 > 0) OVER e + 1.0 AS tau, greatest(min(median_abnormal_m2) OVER e, 0) AS floor FROM ({r.sql['h14_moment_summary']}) WHERE "offset" > 0 WINDOW e AS (PARTITION BY process_class, direction)""")
    r.add("d13_process_predictions", "process_class direction model t", "predicted", lambda s, d: decay.predict_process((x := process_laws(s, d))[0], each_law(x[1], decay.PROCESS_LAWS), kind),
          long("process_laws", "process_class, direction, t", {
              "exponential": "floor + x * exp(-t / tau)", "constrained_mobility": "floor + x * exp(-t / tau) + x * x / 4 * exp(-2 * t / tau)", "stress_fed": "floor + 0.6 * x * exp(-4 * t / tau) + 0.4 * x * exp(-t / (2 * tau))", "shifted_power": "floor + x * pow(1 + t / tau, -0.9)",
          }), digits=5)
    r.add("d14_process_fits", "process_class direction model sample_size", "rmse sse", lambda s, d: decay.fit_process_models(curves(s, d), kind), None, digits=4)
    named = lambda s, d: own["h13_matched_paths"](s, d).withColumn("event_id", F.concat_ws("-", "asset", "event_id"))
    r.add("d12_process_grid", "asset event_id model sample_size", "rmse", lambda s, d: decay.fit_process_models(own["h13_matched_paths"](s, d), ["asset", "event_id"], value="abnormal_m2"), None, digits=4)  # each event's own curve
    r.add("d15_process_validation", "process_class direction model folds", "mean median std", lambda s, d: decay.cross_validate_process_models(named(s, d)), None, digits=4)
    moments = lambda s, d: written(decay.amplitude_sample(named(s, d)), "amplitudes")
    r.add("d18_amplitude_sample", "process_class direction event_id offset t", "x y", lambda s, d: decay.amplitude_sample(named(s, d)),
          """SELECT process_class, direction, event_id, "offset", "offset" - 3 AS t, x, abnormal_m2 AS y FROM (SELECT process_class, direction, asset || '-' || event_id AS event_id, "offset", abnormal_m2, count(abnormal_m2) FILTER ("offset" BETWEEN 1 AND 24) OVER e AS n, greatest(median(abnormal_m2) FILTER ("offset" BETWEEN 1 AND 3) OVER e, 0) AS x FROM hour_paths WINDOW e AS (PARTITION BY asset, event_id))
          WHERE n = 24 AND x > 0.02 AND "offset" BETWEEN 4 AND 24""", digits=6)
    def amplitude_laws(s, d):
        """Laws of each kind of event: the larger its largest amplitude, the longer they last."""
        rows = r.keep(own["d18_amplitude_sample"](s, d))
        return rows, rows.groupBy(*kind).agg((F.max("x") + 2.0).alias("tau")).select(*kind, law_parameters(F.lit(1.0), F.col("tau")).alias("parameters"))

    r.cte("amplitude_laws", f"SELECT *, max(x) OVER (PARTITION BY process_class, direction) + 2.0 AS tau FROM ({r.sql['d18_amplitude_sample']})")
    r.add("d16_amplitude_predictions", "process_class direction event_id model t", "predicted", lambda s, d: decay.predict_amplitude((x := amplitude_laws(s, d))[0], each_law(x[1], decay.AMPLITUDE_LAWS), kind),
          long("amplitude_laws", "process_class, direction, event_id, t", {
              "exponential": "x * exp(-t / tau)", "constrained_mobility": "2 * (sqrt(1 + x) - 1) * exp(-t / tau) + pow(sqrt(1 + x) - 1, 2) * exp(-2 * t / tau)", "landau": "x * exp(-t / tau) / sqrt(1 + 1.4 * x * x * (1 - exp(-2 * t / tau)))",
              "double_exponential": "x * (0.3 * exp(-4 * t / tau) + 0.7 * exp(-t / (2 * tau)))", "shifted_power": "x * pow(1 + t / 1.5, -0.9)",
          }), digits=5)
    r.add("d20_amplitude_fits", "process_class direction model events sample_size converged", "rmse", lambda s, d: decay.amplitude_summary(m := moments(s, d), decay.amplitude_fits(m)), None, digits=3)
    r.add("d21_amplitude_validation", "process_class direction model events winner converged", "mean median std burden_mae_12", lambda s, d: decay.amplitude_validation(moments(s, d)), None, digits=3)

    def streamed(s, d):
        """The closed bars of the events stream, appended to Parquet in the shared folder until the input ends."""
        path = f"{shared_dir(s)}/ohlc-{uuid.uuid4().hex}"
        schema = s.read.parquet(f"{d}/events.parquet").schema
        ticks = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).where("value > 0").select(F.col("event_type").alias("asset"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("quantity"), F.col("event_id").alias("turn"))
        bars = stream_candles(ticks)
        bars.writeStream.outputMode("append").format("parquet").option("path", f"{path}/bars").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
        return s.read.schema(bars.schema).parquet(f"{path}/bars")

    r.add("st1_streamed_candles", "asset begin", "open high low close volume", streamed, "SELECT * FROM hourly WHERE begin + INTERVAL 3 HOUR <= (SELECT max(ts) FROM events WHERE value > 0)")
