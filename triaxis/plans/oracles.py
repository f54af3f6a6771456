"""DuckDB SQL that gives the rows of the catalogue's queries, written apart from them."""

from __future__ import annotations

from ..functions import kernels
from . import queries as q

S = """s AS (SELECT user_id AS patient_id, date_trunc('hour', ts) AS file_ts, ts, value AS x,
 CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS DOUBLE) AS y, CAST(event_id % 13 AS DOUBLE) AS z FROM events)"""
FILES = S + """, f AS (SELECT patient_id, file_ts, count(*) AS n_rows, CAST(hour(file_ts) AS INTEGER) AS hour,
 CAST(isodow(file_ts) - 1 AS INTEGER) AS day_of_week FROM s GROUP BY ALL)"""
W = FILES + """, fw AS (SELECT *, (CASE WHEN hour IN (8, 12, 18) THEN 2e0 ELSE 1e0 END) * (CASE WHEN day_of_week >= 5 THEN 1.5e0 ELSE 1e0 END) AS w FROM f)"""
P = W + """, m AS (SELECT patient_id, avg(w) AS mean_w FROM fw GROUP BY 1), pp AS (SELECT *, mean_w / sum(mean_w) OVER () AS p FROM m)"""


def u(stream: str, *keys: str) -> str:
    text = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(CAST(('0x' || substr(md5(concat_ws(':', '{q.SEED}', '{stream}', {text})), 1, 8)) AS BIGINT) / 4294967296e0)"


DRAWS = P + f""", laid AS (SELECT patient_id, sum(p) OVER o AS hi, p FROM pp WINDOW o AS (ORDER BY substr(md5(CAST(patient_id AS VARCHAR)), 1, 2), patient_id)),
 r AS (SELECT range AS draw_id, {u('patient', '0', 'range')} AS u, {u('file', '0', 'range')} AS uf, {u('offset', '0', 'range')} AS uo FROM range({q.N_DRAWS})),
 picked AS (SELECT r.*, laid.patient_id FROM r JOIN laid ON r.u >= laid.hi - laid.p AND r.u < laid.hi),
 fl AS (SELECT *, w / sum(w) OVER (PARTITION BY patient_id) AS share, coalesce(sum(n_rows) OVER (PARTITION BY patient_id ORDER BY file_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum_len FROM fw),
 fc AS (SELECT *, sum(share) OVER (PARTITION BY patient_id ORDER BY file_ts) AS hi, row_number() OVER (PARTITION BY patient_id ORDER BY file_ts DESC) AS back FROM fl),
 d AS (SELECT draw_id, picked.patient_id, file_ts, CAST(cum_len + floor(uo * n_rows) AS BIGINT) AS start_offset FROM picked JOIN fc
  ON picked.patient_id = fc.patient_id AND uf >= fc.hi - share AND (uf < fc.hi OR back = 1))"""
LINE = DRAWS + """, t AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY file_ts, ts) - 1 AS g FROM s),
 len AS (SELECT patient_id, count(*) AS total FROM s GROUP BY 1)"""


def cut(raw: int) -> str:
    """seq: draw_id, pos, ts, x, y, z of `raw` samples, filled on the left."""
    return LINE + f""", dn AS (SELECT d.*, least({raw}, total - start_offset) AS n FROM d JOIN len USING (patient_id)),
 grid AS (SELECT dn.*, unnest(range({raw})) AS pos FROM dn),
 seq AS (SELECT grid.draw_id, grid.patient_id, CAST(pos AS INTEGER) AS pos, epoch_us(t.ts) AS ts, CASE WHEN pos < {raw} - n THEN 0.57735e0 ELSE t.x END AS x, CASE WHEN pos < {raw} - n THEN 0.57735e0 ELSE t.y END AS y,
  CASE WHEN pos < {raw} - n THEN 0.57735e0 ELSE t.z END AS z FROM grid JOIN t ON t.patient_id = grid.patient_id AND t.g = start_offset + greatest(pos - ({raw} - n), 0))"""


RESAMPLED = S + f""", l AS (SELECT patient_id, file_ts, list(x ORDER BY ts) AS lx, list(y ORDER BY ts) AS ly, list(z ORDER BY ts) AS lz, list(CAST(epoch_us(ts) AS DOUBLE) ORDER BY ts) AS lt, count(*) AS n FROM s GROUP BY 1, 2),
 k AS (SELECT *, CASE WHEN floor(n / {q.FILE_RATIO}) > 0 THEN CAST(floor(n / {q.FILE_RATIO}) AS BIGINT) ELSE n END AS t FROM l),
 g AS (SELECT *, unnest(range(t)) AS j FROM k),
 p AS (SELECT *, CASE WHEN t > 1 THEN j * (n - 1) / CAST(t - 1 AS DOUBLE) ELSE 0e0 END AS p FROM g),
 i AS (SELECT *, CAST(floor(p) AS BIGINT) AS i FROM p)"""
TOD = "(epoch_us(ts) % 86400000000) / 1e6"
LABEL = "printf('%02d:%02d', CAST(floor({0} / 3600) AS INTEGER), CAST(floor(({0} - 3600 * floor({0} / 3600)) / 60) AS INTEGER))"
DAYS = FILES.replace("s AS", "RECURSIVE s AS", 1) + """, ordered AS (SELECT patient_id, file_ts, row_number() OVER (PARTITION BY patient_id ORDER BY file_ts) AS n FROM f),
 days AS (SELECT patient_id, file_ts, n, file_ts AS anchor, CAST(1 AS BIGINT) AS day FROM ordered WHERE n = 1
  UNION ALL SELECT o.patient_id, o.file_ts, o.n, CASE WHEN o.file_ts - d.anchor >= INTERVAL 24 HOUR THEN o.file_ts ELSE d.anchor END,
   d.day + CASE WHEN o.file_ts - d.anchor >= INTERVAL 24 HOUR THEN 1 ELSE 0 END FROM days d JOIN ordered o ON o.patient_id = d.patient_id AND o.n = d.n + 1)"""


def stats(width: int, day: str = "", source: str = "s") -> str:
    start, end = LABEL.format(f"(w * {width})"), LABEL.format(f"(w * {width} + {width})")
    figures = ", ".join(f"round({f}({a}), 6) AS {n}_{b}" for n, f in (("mean", "avg"), ("std", "stddev_pop")) for a, b in (("x", "x"), ("y", "y"), ("z", "z"), ("m", "magnitude")))
    key = "CAST(day AS INTEGER) AS day, " if day else ""
    return f"SELECT patient_id, {start} AS window_start, {end} AS window_end, {key}{figures} FROM (SELECT *, floor({TOD} / {width}) AS w, sqrt(x * x + y * y + z * z) AS m FROM {source}) GROUP BY patient_id, w{day}"


SIGNAL = "sig AS (SELECT event_type AS key, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS idx, value FROM events)"
FRAMES = f"""WITH {SIGNAL}, n AS (SELECT key, count(*) AS n FROM sig GROUP BY 1),
 fr AS (SELECT key, unnest(range(CAST(floor((n - {q.SIZE}) / {q.STEP}) AS BIGINT) + 1)) AS frame FROM n WHERE n >= {q.SIZE}),
 c AS (SELECT fr.key, frame, idx - frame * {q.STEP} AS k, value FROM fr JOIN sig ON sig.key = fr.key AND idx >= frame * {q.STEP} AND idx < frame * {q.STEP} + {q.SIZE}),
 fit AS (SELECT key, frame, regr_slope(value, k) AS b, regr_intercept(value, k) AS a FROM c GROUP BY 1, 2),
 v AS (SELECT c.key, c.frame, k, (value - a - b * k) * (0.5e0 - 0.5e0 * cos(2 * pi() * k / {q.SIZE})) AS v FROM c JOIN fit ON c.key = fit.key AND c.frame = fit.frame),
 dft AS (SELECT key, frame, CAST(bin AS INTEGER) AS bin, sum(v * cos(2 * pi() * k * bin / {q.SIZE})) AS re, sum(v * sin(2 * pi() * k * bin / {q.SIZE})) AS im FROM v, range({q.SIZE // 2 + 1}) b(bin) GROUP BY 1, 2, 3),
 psd AS (SELECT key, frame, bin, (re * re + im * im) * (CASE WHEN bin IN (0, {q.SIZE // 2}) THEN 1e0 ELSE 2e0 END) / ({q.FS} * {3 * q.SIZE / 8}) AS psd FROM dft)"""
PER, HOP = (q.WELCH_FRAME - q.SIZE) // q.STEP, q.WELCH_STEP // q.STEP
WELCH = FRAMES + f""", top AS (SELECT key, max(frame) AS last FROM psd GROUP BY 1),
 outer_frames AS (SELECT key, unnest(range(CAST(floor((last - {PER}) / {HOP}) AS BIGINT) + 1)) AS o FROM top WHERE last >= {PER})
 SELECT psd.key, o AS frame, bin, round(avg(psd), 6) AS psd FROM psd JOIN outer_frames ON psd.key = outer_frames.key AND frame BETWEEN o * {HOP} AND o * {HOP} + {PER} GROUP BY 1, 2, 3"""
BANDS = ", ".join(f"('{n}', {a}e0, {b}e0)" for n, (a, b) in q.BANDS.items())
AXES = """a AS (SELECT vec_id, vec_id % 10 AS batch_id, unnest(range(len(embedding))) AS pos, embedding AS e FROM embeddings),
 v AS (SELECT vec_id, batch_id, CAST(pos AS INTEGER) AS pos, len(e) AS n, CAST(e[pos + 1] AS DOUBLE) AS x, CAST(e[pos + 1] AS DOUBLE) * 2e0 + 1e0 AS y, CAST(e[len(e) - pos] AS DOUBLE) AS z FROM a)"""
OUT = "round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z"


def scaled(a: str) -> str:
    return f"round({a} * (0.8e0 + (1.2e0 - 0.8e0) * {u('scale-' + a, 'vec_id')}), 6) AS {a}"


def noisy(a: str) -> str:
    r, t = u(f"noise-{a}-r", "vec_id", "pos"), u(f"noise-{a}-a", "vec_id", "pos")
    return f"round({a} + 0.1e0 + 0.01e0 * sqrt(-2 * ln(greatest({r}, {2.0**-33}))) * cos(2 * pi() * {t}), 6) AS {a}"


ANGLES = ", ".join(f"{f}(radians((2 * {u('angle-' + a, 'vec_id')} - 1) * 30e0)) AS {f[0]}{a}" for a in "xyz" for f in ("cos", "sin"))
PARTS = 5
#: As many taps as a sequence has samples.
LONG_TAPS = ", ".join(f"({j}, {h!r})" for j, h in enumerate(kernels.bandpass_taps()[:64].tolist()))
ORDER = ", ".join(f"{{'u': {u('channel-' + a, 'batch_id')}, 'i': {i}}}" for i, a in enumerate("xyz"))
PART_U = " ".join(f"WHEN {i} THEN {u(f'part-{i}', 'vec_id')}" for i in range(PARTS))


def oracle_sql() -> dict[str, str]:
    size = f"CASE WHEN i = {PARTS - 1} THEN n - {PARTS - 1} * (n // {PARTS}) ELSE n // {PARTS} END"
    taps = " + ".join(f"CASE WHEN pos >= {j} THEN e[pos + 1 - {j}] * {h!r} ELSE 0 END" for j, h in enumerate(q.taps()))
    raw, length = int(q.LENGTH * q.RATIO), q.LENGTH
    step = f"(j * {float(raw - 1)} / {length - 1})"
    mid = ", ".join(f"round(a.{c} + ({step} - floor({step})) * (b.{c} - a.{c}), 6) AS {c}" for c in "xyz")
    pick = lambda c: f"l{c}[i + 1] + (p - i) * (l{c}[least(i + 2, n)] - l{c}[i + 1])"
    simpson = """CASE WHEN n = 2 THEN 0.5e0 ELSE (CASE WHEN i = 0 OR i = odd - 1 THEN 1e0 WHEN i < odd THEN CASE WHEN i % 2 = 1 THEN 4e0 ELSE 2e0 END ELSE 0e0 END) / 3e0
 + CASE WHEN n % 2 = 0 THEN (CASE WHEN i = n - 1 THEN 5e0 WHEN i = n - 2 THEN 8e0 WHEN i = n - 3 THEN -1e0 ELSE 0e0 END) / 12e0 ELSE 0e0 END END"""
    return {
        "file_catalog": f"WITH {FILES} SELECT * FROM f",
        "hour_weights": "SELECT CAST(range AS INTEGER) AS hour, CASE WHEN range IN (8, 12, 18) THEN 2e0 ELSE 1e0 END AS weight FROM range(24)",
        "day_weights": "SELECT CAST(range AS INTEGER) AS day_of_week, CASE WHEN range >= 5 THEN 1.5e0 ELSE 1e0 END AS weight FROM range(7)",
        "file_weights": f"WITH {W} SELECT patient_id, file_ts, w FROM fw",
        "normalized_weights": f"WITH {W} SELECT patient_id, file_ts, round(w / sum(w) OVER (PARTITION BY patient_id), 6) AS share FROM fw",
        "patient_probability": f"WITH {P} SELECT patient_id, round(mean_w, 6) AS mean_w, round(p, 6) AS p FROM pp",
        "weighted_draws": f"WITH {DRAWS} SELECT * FROM d",
        "draws_without_replacement": f"WITH {P}, k AS (SELECT patient_id, -ln(greatest({u('once', '0', 'patient_id')}, {2.0**-33})) / p AS key FROM pp WHERE p > 0), top AS (SELECT * FROM k ORDER BY key, patient_id LIMIT {q.N_ONCE}) SELECT CAST(row_number() OVER (ORDER BY key, patient_id) - 1 AS INTEGER) AS rank, patient_id FROM top",
        "file_offsets_cumulative": f"WITH {FILES} SELECT patient_id, file_ts, n_rows, CAST(coalesce(sum(n_rows) OVER (PARTITION BY patient_id ORDER BY file_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cum_len FROM f",
        "offset_asof_file": f"WITH {DRAWS} SELECT draw_id, d.patient_id, start_offset, fl.file_ts AS found_ts, CAST(start_offset - cum_len AS BIGINT) AS row_idx FROM d ASOF JOIN fl ON d.patient_id = fl.patient_id AND d.start_offset >= fl.cum_len",
        "extract_sequence_padded": f"WITH {cut(length)} SELECT draw_id, pos, ts, {OUT} FROM seq",
        "extract_sequence_downsampled": f"WITH {cut(raw)}, j AS (SELECT range AS j FROM range({length})) SELECT a.draw_id, CAST(j AS INTEGER) AS pos, {mid} FROM j JOIN seq a ON a.pos = floor({step}) JOIN seq b ON b.draw_id = a.draw_id AND b.pos = least(floor({step}) + 1, {raw - 1})",
        "extract_file_sequence": f"WITH {DRAWS}, o AS (SELECT draw_id, d.patient_id, fl.file_ts, start_offset - cum_len AS place, n_rows, least(4, n_rows - (start_offset - cum_len)) AS n FROM d ASOF JOIN fl ON d.patient_id = fl.patient_id AND d.start_offset >= fl.cum_len), t AS (SELECT *, row_number() OVER (PARTITION BY patient_id, file_ts ORDER BY ts) - 1 AS g FROM s), grid AS (SELECT *, unnest(range(4)) AS pos FROM o) SELECT draw_id, CAST(pos AS INTEGER) AS pos, epoch_us(t.ts) AS ts, {', '.join(f'round(CASE WHEN pos < 4 - n THEN 0e0 ELSE {c} END, 6) AS {c}' for c in 'xyz')} FROM grid JOIN t ON t.patient_id = grid.patient_id AND t.file_ts = grid.file_ts AND g = place + greatest(pos - (4 - n), 0)",
        "live_statistics": f"WITH {S}, m AS (SELECT patient_id, time_bucket(INTERVAL 2 HOUR, ts) AS window_start, sqrt(x * x + y * y + z * z) AS m FROM s) SELECT patient_id, window_start, window_start + INTERVAL 2 HOUR AS window_end, count(*) AS n, round(avg(m), 6) AS mean_magnitude, round(stddev_pop(m), 6) AS std_magnitude FROM m GROUP BY 1, 2",
        "batch_collate": f"WITH {DRAWS} SELECT draw_id // {q.BATCH} AS batch_id, CAST(draw_id % {q.BATCH} AS INTEGER) AS slot, draw_id, patient_id FROM d WHERE draw_id // {q.BATCH} < {q.N_DRAWS // q.BATCH}",
        "batch_loss": f"WITH {cut(length)} SELECT draw_id // {q.BATCH} AS batch_id, round(sum(x * x + y * y + z * z) / (3 * count(*)), 6) AS loss FROM seq WHERE draw_id // {q.BATCH} < {q.N_DRAWS // q.BATCH} GROUP BY 1",
        "window_stats_combined": f"WITH {S} {stats(7200)}",
        "window_stats_per_day": f"WITH {DAYS}, sd AS (SELECT s.*, day FROM s JOIN days USING (patient_id, file_ts)) {stats(18000, ', day', 'sd')}",
        "epoch_loss": f"WITH {cut(length)}, b AS (SELECT draw_id // {q.BATCH} AS batch_id, sum(x * x + y * y + z * z) / (3 * count(*)) AS loss FROM seq WHERE draw_id // {q.BATCH} < {q.N_DRAWS // q.BATCH} GROUP BY 1) SELECT count(*) AS n_batches, round(avg(loss), 6) AS loss FROM b",
        "window_stats_resampled": f"WITH {RESAMPLED}, rs AS (SELECT patient_id, make_timestamp(CAST(floor({pick('t')}) AS BIGINT)) AS ts, {pick('x')} AS x, {pick('y')} AS y, {pick('z')} AS z FROM i) {stats(7200, source='rs')}",
        "window_days_summary": f"WITH {DAYS}, sd AS (SELECT s.*, day FROM s JOIN days USING (patient_id, file_ts)), w AS ({stats(18000, ', day', 'sd')}) SELECT patient_id, count(*) AS n_windows, min(window_start) AS first_start, max(window_end) AS last_end, min(mean_magnitude) AS min_mean_magnitude, max(mean_magnitude) AS max_mean_magnitude, min(std_magnitude) AS min_std_magnitude, max(std_magnitude) AS max_std_magnitude, CAST(min(day) AS BIGINT) AS min_day, CAST(max(day) AS BIGINT) AS max_day FROM w GROUP BY 1",
        "window_stats_summary": f"WITH {S}, w AS ({stats(7200)}) SELECT patient_id, count(*) AS n_windows, min(window_start) AS first_start, max(window_end) AS last_end, min(mean_magnitude) AS min_mean_magnitude, max(mean_magnitude) AS max_mean_magnitude, min(std_magnitude) AS min_std_magnitude, max(std_magnitude) AS max_std_magnitude FROM w GROUP BY 1",
        "day_buckets": f"WITH {DAYS} SELECT patient_id, file_ts, day FROM days",
        "time_of_day": f"WITH {S} SELECT patient_id, ts, round({TOD}, 6) AS tod, {LABEL.format('(' + TOD + ')')} AS label FROM s",
        "magnitude": f"WITH {S} SELECT patient_id, ts, round(sqrt(x * x + y * y + z * z), 6) AS m FROM s",
        "axis_mean": f"WITH {S} SELECT patient_id, ts, round((x + y + z) / 3e0, 6) AS axis_mean FROM s",
        "day_tick_labels": f"WITH {DAYS}, sd AS (SELECT s.patient_id, day, ts, row_number() OVER o - 1 AS pos, count(*) OVER (PARTITION BY s.patient_id, day) AS n FROM s JOIN days USING (patient_id, file_ts) WINDOW o AS (PARTITION BY s.patient_id, day ORDER BY ts)) SELECT patient_id, day, CAST(pos AS INTEGER) AS pos, {LABEL.format('(' + TOD + ')')} AS tick FROM sd WHERE pos % greatest(1, n // 12) = 0",
        "resample_file": f"WITH {RESAMPLED} SELECT patient_id, file_ts, j, round({pick('x')}, 6) AS x, round({pick('y')}, 6) AS y, round({pick('z')}, 6) AS z FROM i",
        "resample_sequence": "WITH g AS (SELECT vec_id, embedding AS lx, len(embedding) AS n, unnest(range(20)) AS j FROM embeddings), p AS (SELECT *, j * (n - 1) / 19e0 AS p FROM g), i AS (SELECT *, CAST(floor(p) AS BIGINT) AS i FROM p) SELECT vec_id, CAST(j AS INTEGER) AS j, round(CAST(lx[i + 1] AS DOUBLE) + (p - i) * (CAST(lx[least(i + 2, n)] AS DOUBLE) - CAST(lx[i + 1] AS DOUBLE)), 6) AS value FROM i",
        "distinct_patients": f"WITH {DRAWS} SELECT DISTINCT patient_id FROM d",
        "patient_share": f"WITH {DRAWS} SELECT patient_id, count(*) AS n, round(100e0 * count(*) / {q.N_DRAWS}, 6) AS percent FROM d GROUP BY 1",
        "hour_histogram": f"WITH {DRAWS} SELECT CAST(hour(file_ts) AS INTEGER) AS hour, count(*) AS n, round(100e0 * count(*) / {q.N_DRAWS}, 6) AS percent FROM d GROUP BY 1",
        "sequence_duration": f"WITH {cut(length)} SELECT draw_id, patient_id, min_by(ts, pos) AS first_us, max_by(ts, pos) AS last_us, round((max_by(ts, pos) - min_by(ts, pos)) / 1e6, 6) AS seconds FROM seq GROUP BY 1, 2",
        "dft_power": "WITH a AS (SELECT vec_id, unnest(range(64)) AS k, embedding AS e FROM embeddings), d AS (SELECT vec_id, CAST(bin AS INTEGER) AS bin, sum(CAST(e[k + 1] AS DOUBLE) * cos(2 * pi() * k * bin / 64)) AS re, sum(CAST(e[k + 1] AS DOUBLE) * sin(2 * pi() * k * bin / 64)) AS im FROM a, range(33) b(bin) GROUP BY 1, 2) SELECT vec_id, bin, round((re * re + im * im) * (CASE WHEN bin IN (0, 32) THEN 1e0 ELSE 2e0 END) / 4096e0, 6) AS power FROM d",
        "stft_frames": FRAMES + " SELECT key, frame, bin, round(psd, 6) AS psd FROM psd",
        "stft_average": FRAMES + f", av AS (SELECT key, frame, bin, avg(psd) OVER (PARTITION BY key, bin ORDER BY frame ROWS BETWEEN {q.AVERAGED - 1} PRECEDING AND CURRENT ROW) AS psd FROM psd) SELECT key, frame, bin, round(psd, 6) AS psd FROM av WHERE frame >= {q.AVERAGED - 1}",
        "welch_psd": WELCH,
        "band_power": FRAMES + f", b AS (SELECT * FROM (VALUES {BANDS}) t(band, low, high)), r AS (SELECT key, frame, band, psd, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY key, frame, band) AS n FROM psd JOIN b ON bin * {q.FS} / {q.SIZE} > low AND bin * {q.FS} / {q.SIZE} <= high WINDOW o AS (PARTITION BY key, frame, band ORDER BY bin)), w AS (SELECT *, n - CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS odd FROM r), area AS (SELECT key, frame, band, CASE WHEN max(n) > 1 THEN sum(psd * {q.FS / q.SIZE} * ({simpson})) ELSE 0e0 END AS power FROM w GROUP BY 1, 2, 3) SELECT k.key, k.frame, b.band, round(coalesce(power, 0e0), 6) AS power FROM (SELECT DISTINCT key, frame FROM psd) k CROSS JOIN b LEFT JOIN area ON area.key = k.key AND area.frame = k.frame AND area.band = b.band",
        "spectrum_db": FRAMES + " SELECT key, bin, round(10e0 * log10(avg(psd) + 1e-10), 6) AS db FROM psd GROUP BY 1, 2",
        "stft_kernel": FRAMES + f" SELECT key, frame, round(({q.SIZE / 2} + {q.STEP} * frame) / {q.FS}, 6) AS time_s, bin, round(bin * {q.FS} / {q.SIZE}, 6) AS freq_hz, round(psd, 6) AS psd FROM psd",
        "welch_kernel": WELCH,
        "spectrogram_plain": f"WITH {SIGNAL}, n AS (SELECT key, count(*) AS n FROM sig GROUP BY 1), fr AS (SELECT key, unnest(range(CAST(floor((n - 256) / 128) AS BIGINT) + 1)) AS frame FROM n WHERE n >= 256), v AS (SELECT fr.key, frame, idx - frame * 128 AS k, value * (0.54e0 - 0.46e0 * cos(2 * pi() * (idx - frame * 128) / 255)) AS v FROM fr JOIN sig ON sig.key = fr.key AND idx >= frame * 128 AND idx < frame * 128 + 256), dft AS (SELECT key, frame, CAST(bin AS INTEGER) AS bin, sum(v * cos(2 * pi() * k * bin / 256)) AS re, sum(v * sin(2 * pi() * k * bin / 256)) AS im FROM v, range(129) b(bin) GROUP BY 1, 2, 3) SELECT key, frame, round((128 + 128 * frame) / 100e0, 6) AS time_s, bin, round(bin * 100e0 / 256, 6) AS freq_hz, round((re * re + im * im) * (CASE WHEN bin IN (0, 128) THEN 1e0 ELSE 2e0 END) / (100 * (SELECT sum(pow(0.54e0 - 0.46e0 * cos(2 * pi() * k / 255), 2)) FROM range(256) w(k))), 6) AS psd FROM dft",
        "stride_decimation": f"WITH {SIGNAL}, n AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM sig) SELECT key, idx, value FROM n WHERE idx % greatest(1, n // 100) = 0",
        "aug_invert": f"WITH {AXES} SELECT vec_id, pos, round(-x, 6) AS x, round(-y, 6) AS y, round(-z, 6) AS z FROM v",
        "aug_reverse": f"WITH {AXES} SELECT vec_id, CAST(n - 1 - pos AS INTEGER) AS pos, {OUT} FROM v",
        "aug_scale": f"WITH {AXES} SELECT vec_id, pos, {scaled('x')}, {scaled('y')}, {scaled('z')} FROM v",
        "aug_noise": f"WITH {AXES} SELECT vec_id, pos, {noisy('x')}, {noisy('y')}, {noisy('z')} FROM v",
        "aug_rotate": f"WITH {AXES}, t AS (SELECT *, {ANGLES} FROM v) SELECT vec_id, pos, round(cz * cy * x + (cz * sy * sx - sz * cx) * y + (cz * sy * cx + sz * sx) * z, 6) AS x, round(sz * cy * x + (sz * sy * sx + cz * cx) * y + (sz * sy * cx - cz * sx) * z, 6) AS y, round(-sy * x + cy * sx * y + cy * cx * z, 6) AS z FROM t",
        "aug_scramble": f"WITH {AXES}, i AS (SELECT *, least(pos // (n // {PARTS}), {PARTS - 1}) AS i FROM v), parts AS (SELECT vec_id, i, {size} AS size, CASE i {PART_U} END AS u FROM (SELECT DISTINCT vec_id, n, i FROM i)), placed AS (SELECT vec_id, i, coalesce(sum(size) OVER (PARTITION BY vec_id ORDER BY u, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM parts) SELECT i.vec_id, CAST(first + pos - i.i * (n // {PARTS}) AS INTEGER) AS pos, {OUT} FROM i JOIN placed ON placed.vec_id = i.vec_id AND placed.i = i.i",
        "aug_channel_shuffle": f"WITH {AXES}, o AS (SELECT *, list_transform(list_sort([{ORDER}]), lambda t: t.i) AS o, [x, y, z] AS c FROM v) SELECT vec_id, pos, round(c[o[1] + 1], 6) AS x, round(c[o[2] + 1], 6) AS y, round(c[o[3] + 1], 6) AS z FROM o",
        "aug_pipeline": f"WITH {AXES} SELECT vec_id, CAST(n - 1 - pos AS INTEGER) AS pos, round(-x, 6) AS x, round(-y, 6) AS y, round(-z, 6) AS z FROM v",
        "bandpass_fir": f"WITH a AS (SELECT vec_id, unnest(range(len(embedding))) AS pos, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, CAST(pos AS INTEGER) AS pos, round({taps}, 6) AS value FROM a",
        "bandpass_long": f"WITH {AXES}, h AS (SELECT * FROM (VALUES {LONG_TAPS}) t(j, h)) SELECT v.vec_id, v.pos, {', '.join(f'round(sum(u.{c} * h), 6) AS {c}' for c in 'xyz')}, 256.5e0 AS delay FROM v JOIN v u ON v.vec_id = u.vec_id AND u.pos <= v.pos JOIN h ON h.j = v.pos - u.pos GROUP BY 1, 2",
    }
