"""Timeline operators at work on odd clips and in larger plans."""

from pyspark.sql import functions as F

from refrain.operators import timeline as T

CLIPS = "project_id long, clip_id string, start_time double, trim_start double, trim_end double, gain double, fade_in_sec double, fade_out_sec double, speed double"


def _clips(spark):
    rows = [(k % 7, f"c{k}", 0.37 * k, 0.1 * (k % 3), 0.1 * (k % 3) + (k % 90) / 7, k % 5 / 2, k % 4 * 0.8, k % 6 * 0.5, 0.1 + k % 9 * 0.4) for k in range(300)]
    nan, inf = float("nan"), float("inf")
    rows += [(1, "c8", 5.0, 0.0, 3.0, 1.0, 0.5, 0.5, 1.0), (8, "null", 1.0, 0.0, 2.0, None, 0.0, 0.0, 1.0), (8, "start", None, 0.0, 2.0, 1.0, 0.0, 0.0, 1.0)]
    rows += [(8, "trim", 1.0, None, 2.0, 1.0, 0.0, 0.0, 1.0), (8, "fade", 1.0, 0.0, 2.0, 1.0, None, 0.5, 1.0), (8, "nan", 1.0, 0.0, 2.0, nan, 0.0, 0.0, 1.0), (8, "inf", 1.0, 0.0, 2.0, 1.0, inf, 0.0, 1.0), (8, "none", 1.0, 2.0, 2.0, 1.0, 0.0, 0.0, 1.0)]
    return spark.createDataFrame(rows, CLIPS)


def test_gain_totals_are_those_of_the_points(spark):
    """Every clip, the odd and the repeated included, has the totals of its points, and no row per point is made for it."""
    clips = _clips(spark)
    key = ["project_id", "clip_id"]
    want = T.gain_points(clips).groupBy(*key).agg(F.count(F.lit(1)), F.sum("value"), F.max("value"))
    show = lambda df: {(r[0], r[1]): (r[2], *(None if x is None else f"{x:.9g}" for x in r[3:])) for r in df.collect()}
    out = T.gain_totals(clips)
    assert show(out) == show(want) and out.count() == 307
    usual = T.gain_totals(clips.where("project_id < 7"))
    assert "MapInArrow" in usual._jdf.queryExecution().executedPlan().toString()


def _plan_tables(spark):
    """Clips of three projects and a null one, with rows, labels and buffers that are null, missing or repeated."""
    cols = "project_id long, clip_id string, buffer_id string, start_time double, row int, layer_index int, trim_start double, trim_end double, gain double, fade_in_sec double, fade_out_sec double, speed double, label string, picked boolean"
    rows = []
    for k in range(160):
        project = None if k % 41 == 0 else k % 3
        numbers = [0.5 * k, k % 5 - 0.25 * (k % 2), 4.0 + k % 3, None if k % 23 == 0 else float("nan") if k % 29 == 0 else 1.0, 0.1, 0.1, k % 7 - 1.0]
        rows.append((project, f"c{k % 150}", None if k % 37 == 0 else f"b{k % 19}", numbers[0], None if k % 31 == 0 else (k * 5000) % 17011, k, *numbers[1:], f"l{k}" if k % 2 else None, None if k % 43 == 0 else k % 3 != 1))
    clips = spark.createDataFrame(rows, cols)
    buffers = spark.createDataFrame([(f"b{k % 15}", f"n{k}" if k % 4 else None, 1.0 * k) for k in range(17)], "buffer_id string, name string, duration_sec double")
    stems = spark.createDataFrame([(f"b{k}", kind, f"b{k}.{kind}", i, 1.5) for k in range(1, 17) for i, kind in enumerate(("drums", "bass", "other", "vocals"))], "source_buffer_id string, kind string, buffer_id string, stem_idx int, duration_sec double")
    return clips, buffers, stems


def _rows(df):
    return sorted(map(str, df.collect()))


def _clip_joins(node):
    """Joins whose rows carry a clip."""
    below = sum(_clip_joins(node.children().apply(i)) for i in range(node.children().size()))
    return below + (node.nodeName() == "Join" and "clip_id" in node.output().mkString(","))


def test_layer_plan_joins_clips_twice(spark):
    """Stems land on the rows that plain windows give them; the clips meet one table per row and one per buffer."""
    clips, buffers, stems = _plan_tables(spark)
    clips.createOrReplaceTempView("clips"), buffers.createOrReplaceTempView("buffers"), stems.createOrReplaceTempView("stems")
    want = spark.sql("""
        WITH top AS (SELECT project_id, max(row) AS top FROM clips GROUP BY 1),
          rk AS (SELECT project_id, row, row_number() OVER (PARTITION BY project_id ORDER BY row) - 1 AS rk FROM (SELECT DISTINCT project_id, row FROM clips WHERE picked))
        SELECT project_id, clip_id, buffer_id, row, label FROM clips WHERE NOT picked
        UNION ALL SELECT c.project_id, concat(c.clip_id, '#', s.kind), s.buffer_id, CAST(if(s.stem_idx = 0, c.row, top + 1 + rk * 3 + s.stem_idx - 1) AS INT),
          concat(coalesce(c.label, b.name, 'Clip'), ' · ', initcap(s.kind))
        FROM clips c JOIN top USING (project_id) JOIN rk ON rk.project_id = c.project_id AND rk.row = c.row
        LEFT JOIN buffers b ON b.buffer_id = c.buffer_id JOIN stems s ON s.source_buffer_id = c.buffer_id WHERE c.picked""")
    plan = T.layer_plan(clips, buffers, stems, F.col("picked"), 4)
    out = plan.select("project_id", "clip_id", "buffer_id", "row", "label")
    assert _rows(out) == _rows(want) and out.count() > 300
    assert _clip_joins(out._jdf.queryExecution().optimizedPlan()) == 2  # four before
    held = T.layer_plan_buffers(plan, buffers, stems)
    assert "RepartitionByExpression [buffer_id" in held._jdf.queryExecution().optimizedPlan().toString()  # ids are dealt out before the grouping
    used = {r.buffer_id for r in plan.select("buffer_id").collect()}
    names = [r.buffer_id for r in held.collect()]
    assert sorted(n for n in names if "." not in n) == sorted(r.buffer_id for r in buffers.collect() if r.buffer_id in used)
    assert sum("." in n for n in names) == stems.join(buffers.withColumnRenamed("buffer_id", "source_buffer_id"), "source_buffer_id", "left").count()


def test_projects_are_validated_in_one_pass(spark):
    """Every rule, null keys, repeated ids and numbers that are not finite, against a plain scan per rule."""
    clips, _, _ = _plan_tables(spark)
    nan = float("nan")
    buffers = spark.createDataFrame(
        [(p, b, n, s) for p in (0, 1, 2, None) for b, n, s in (("b1", "x", 1.0), ("b1", "x", 2.0), ("b2", None, 1.0), ("b3", "x", nan), ("b4", "x", -1.0), ("", "x", 1.0), (None, "x", 1.0), ("b5", "x", 1.0))],
        "project_id long, buffer_id string, name string, duration_sec double",
    )
    audio = spark.createDataFrame(
        [(p, b, n) for p in (0, 1, None) for b, n in (("b1", 5.0), ("b2", 0.0), ("b9", 2.5), ("b9", 3.0), (None, 4.0), ("b5", None))], "project_id long, buffer_id string, byte_length double"
    )
    clips.createOrReplaceTempView("vc"), buffers.createOrReplaceTempView("vb"), audio.createOrReplaceTempView("va")
    fine = lambda c: f"({c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('inf'))"
    numbers = " AND ".join(map(fine, ("start_time", "row", "layer_index", "trim_start", "trim_end", "gain", "fade_in_sec", "fade_out_sec", "speed")))
    lone = lambda x, y, i, rule: f"SELECT project_id, '{rule}' AS rule, {i} AS id FROM {x} x WHERE NOT EXISTS (SELECT 1 FROM {y} y WHERE y.project_id = x.project_id AND y.buffer_id = x.buffer_id)"
    twice = lambda x, i, rule: f"SELECT project_id, '{rule}', {i} FROM {x} GROUP BY project_id, {i} HAVING count(*) > 1"
    want = spark.sql(" UNION ".join([
        lone("vc", "vb", "clip_id", "clip-without-buffer"), lone("vb", "va", "buffer_id", "buffer-without-audio"), lone("va", "vb", "buffer_id", "audio-without-buffer"),
        twice("vb", "buffer_id", "duplicate-buffer"), twice("vc", "clip_id", "duplicate-clip"), twice("va", "buffer_id", "duplicate-audio"),
        f"SELECT project_id, 'bad-buffer', buffer_id FROM vb WHERE coalesce(NOT ({fine('duration_sec')} AND duration_sec >= 0 AND name IS NOT NULL AND length(buffer_id) > 0), true)",
        "SELECT project_id, 'bad-audio-length', buffer_id FROM va WHERE coalesce(NOT (byte_length > 0 AND byte_length = floor(byte_length)), true)",
        f"SELECT project_id, 'bad-number', clip_id FROM vc WHERE NOT ({numbers})",
        "SELECT project_id, 'bad-trim', clip_id FROM vc WHERE coalesce(NOT (trim_start >= 0 AND trim_end > trim_start), true)",
        "SELECT project_id, 'bad-speed', clip_id FROM vc WHERE coalesce(NOT (speed > 0), true)",
    ]))
    out = T.validate_projects(clips, buffers, audio)
    assert _rows(out) == _rows(want)
    assert len({r.rule for r in out.collect()}) == 11
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # before: three anti joins, and a read per rule
