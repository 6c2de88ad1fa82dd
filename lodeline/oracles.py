"""Plain SQL for each registered query, to be run by another engine on the driver tables."""

from __future__ import annotations

import re

FORMATIONS = ["ancc", "astnu", "astnl", "egfdu", "egfdl", "buda"]

SERIES = """
series AS MATERIALIZED (
  WITH o AS (
    SELECT l_suppkey AS sk, l_linenumber AS ln, l_quantity AS q, l_extendedprice AS ep, l_discount AS dc, l_tax AS tx,
           row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS ri,
           count(*) OVER (PARTITION BY l_suppkey) AS n
    FROM lineitem),
  c AS (
    SELECT sk, ln, ep, ri, n,
           sum(q) OVER w AS cq,
           CAST(sum(CAST(round(dc * 100) AS bigint) - 5) OVER w AS double) AS cx,
           CAST(sum(CAST(round(tx * 100) AS bigint) - 4) OVER w AS double) AS cy
    FROM o WINDOW w AS (PARTITION BY sk ORDER BY ri ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  b AS (
    SELECT concat('w', repeat('0', greatest(0, 6 - length(CAST(sk AS string)))), CAST(sk AS string)) AS well_id, CAST(ri AS int) AS row_idx,
           CASE WHEN sk % 10 = 9 THEN 'test' ELSE 'train' END AS split, sk, n,
           1000.0e0 + cq AS md, sk * 10.0e0 + cx AS x, sk * 5.0e0 + cy AS y, -9000.0e0 - cq / 64 + cx / 8 AS z,
           CASE WHEN ln = 7 AND ri % 3 = 0 THEN NULL ELSE 30.0e0 + floor(ep) % 120 END AS gr,
           5000.0e0 + sk * 4 + cq / 32 + cy / 4 AS tvt
    FROM c)
  SELECT well_id, row_idx, split, md, x, y, z, CAST(gr AS double) AS gr, tvt,
         CASE WHEN row_idx < floor(n * 3 / 5) THEN tvt END AS tvt_input,
         CASE WHEN sk % 20 <> 0 THEN -9050.0e0 + x / 64 + y / 32 END AS ancc,
         CASE WHEN sk % 20 <> 0 THEN -9080.0e0 + x / 64 + y / 32 END AS astnu,
         CASE WHEN sk % 20 <> 0 THEN -9110.0e0 + x / 64 + y / 32 END AS astnl,
         CASE WHEN sk % 20 <> 0 THEN -9140.0e0 + x / 64 + y / 32 END AS egfdu,
         CASE WHEN sk % 20 <> 0 THEN -9170.0e0 + x / 64 + y / 32 END AS egfdl,
         CASE WHEN sk % 20 <> 0 THEN -9200.0e0 + x / 64 + y / 32 END AS buda
  FROM b)"""

REFERENCE = """
reference AS MATERIALIZED (
  SELECT concat('w', repeat('0', greatest(0, 6 - length(CAST(l_suppkey AS string)))), CAST(l_suppkey AS string)) AS well_id, CAST(i AS int) AS tw_idx,
         4900.0e0 + l_suppkey * 4 + i * 4 AS tvt,
         CAST(30.0e0 + floor(p_retailprice * 13 + p_size * 7) % 120 AS double) AS gr, p_type AS geology
  FROM (SELECT l_suppkey, p_retailprice, p_size, p_type,
               row_number() OVER (PARTITION BY l_suppkey ORDER BY p_partkey) - 1 AS i
        FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey))"""

ANCHORS = """
anchors AS MATERIALIZED (
  SELECT well_id, any_value(split) AS split, count(*) AS n,
         coalesce(min(CASE WHEN tvt_input IS NULL THEN row_idx END), max(row_idx)) AS ps,
         count(*) FILTER (WHERE tvt_input IS NULL) > 0 AS has_cut,
         arg_max(tvt_input, row_idx) FILTER (WHERE tvt_input IS NOT NULL) AS last_known,
         arg_max(md, row_idx) FILTER (WHERE tvt_input IS NOT NULL) AS md_last,
         arg_max(z, row_idx) FILTER (WHERE tvt_input IS NOT NULL) AS z_last,
         count(tvt_input) AS known_rows
  FROM series GROUP BY well_id)"""

CUT = """
cut AS MATERIALIZED (
  SELECT a.*, s.md AS md_cut, s.x AS x_cut, s.y AS y_cut, s.z AS z_cut
  FROM anchors a JOIN series s ON s.well_id = a.well_id AND s.row_idx = a.ps)"""

OOF = """
oof AS MATERIALIZED (
  SELECT s.well_id, s.row_idx, CAST(substr(s.well_id, 2) AS int) % 5 AS fold, tvt - last_known AS y_true,
         z - z_cut AS y_pred, (md - md_cut) / 32 AS y_pred_b, last_known AS baseline
  FROM series s JOIN cut c USING (well_id) WHERE s.split = 'train' AND tvt_input IS NULL)"""

PARTS = {"series": SERIES, "reference": REFERENCE, "anchors": ANCHORS, "cut": CUT, "oof": OOF}
NEEDS = {"anchors": ["series"], "cut": ["anchors"], "oof": ["cut"]}


def _with(parts: str, body: str) -> str:
    """``body`` preceded by the named common tables and what they are built from."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for p in parts.split():
        add(p)
    ctes = [PARTS[p] for p in order]
    # Adding 0 turns a rounded -0.0 into 0.0.
    body = re.sub(r", ([456])\) AS ", r", \1) + 0 AS ", body.strip())
    if body.upper().startswith("WITH "):
        return "WITH RECURSIVE " + ",".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",".join(ctes) + "\n" + body


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) AS {name}"


def _roll(c: str, before: int, after: int, fn: str = "avg") -> str:
    return (
        f"coalesce({fn}({c}) OVER (PARTITION BY well_id ORDER BY row_idx "
        f"ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING), 0)"
    )


W = "OVER (PARTITION BY well_id ORDER BY row_idx)"


def _windows() -> dict[str, str]:
    sql = {}
    sql["base_features"] = _with(
        "series",
        """SELECT well_id, row_idx, md, x, y, z, gr,
        round(CASE WHEN max(md) OVER g > min(md) OVER g
              THEN (md - min(md) OVER g) / (max(md) OVER g - min(md) OVER g) ELSE 0 END, 6) AS md_relative
        FROM series WINDOW g AS (PARTITION BY well_id)""",
    )
    geometry = f"""SELECT well_id, row_idx, md - md_cut AS md_since_ps, x - x_cut AS dx_since_ps, y - y_cut AS dy_since_ps,
        z - z_cut AS dz_since_ps, round(sqrt((x - x_cut) ** 2 + (y - y_cut) ** 2), 6) AS dxy_since_ps,
        round(CASE WHEN row_idx >= ps AND n - ps > 1 THEN (row_idx - ps) / CAST(n - ps - 1 AS double) ELSE 0 END, 6)
          AS frac_after_ps,
        round(coalesce((x - lag(x) {W}) / nullif(md - lag(md) {W}, 0), 0), 6) AS dxdmd,
        round(coalesce((y - lag(y) {W}) / nullif(md - lag(md) {W}, 0), 0), 6) AS dydmd,
        round(coalesce((z - lag(z) {W}) / nullif(md - lag(md) {W}, 0), 0), 6) AS dzdmd
        FROM series JOIN cut USING (well_id)"""
    sql["geometry"] = _with("cut", geometry)
    rolls = ", ".join(
        f"round({_roll('gr', w // 2, w // 2)}, 6) AS gr_roll_mean_{w}, "
        f"round({_roll('gr', w // 2, w // 2, 'stddev_samp')}, 6) AS gr_roll_std_{w}"
        for w in (5, 21, 51, 101)
    )
    sql["rolling_signal"] = _with("series", f"SELECT well_id, row_idx, {rolls} FROM series")
    lags = ", ".join(
        f"coalesce({fn}(gr, {k}) {W}, 0) AS gr_{fn}_{k}" for fn in ("lag", "lead") for k in (1, 5, 15, 30)
    )
    sql["lag_lead"] = _with(
        "series",
        f"""SELECT well_id, row_idx, {lags}, coalesce(gr - lag(gr) {W}, 0) AS gr_d1,
        coalesce((gr - lag(gr) {W}) - (lag(gr) {W} - lag(gr, 2) {W}), 0) AS gr_d2 FROM series""",
    )
    energy = (
        f"round(coalesce(sum(gr * gr) {W}, 0) / greatest(count(gr) {W}, 1), 6) AS gr_energy"
    )
    sql["cum_energy"] = _with("series", f"SELECT well_id, row_idx, {energy} FROM series")
    env = "OVER (PARTITION BY well_id ORDER BY row_idx ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)"
    sql["envelope"] = _with(
        "series", f"SELECT well_id, row_idx, max(gr) {env} - min(gr) {env} AS gr_envelope FROM series"
    )
    sql["z_drift"] = _with(
        "cut",
        """SELECT well_id, row_idx, coalesce(last_known - z_cut, 0) AS z_drift_offset_at_anchor,
        coalesce(z + (last_known - z_cut), 0) AS z_drift_implied_tvt,
        coalesce(greatest(-100, least(100, z + (last_known - z_cut) - last_known)), 0) AS z_drift_implied_tvt_resid
        FROM series JOIN cut USING (well_id)""",
    )
    sql["z_physics"] = _with(
        "cut",
        """SELECT well_id, row_idx, CASE WHEN row_idx >= ps THEN z + (last_known - z_cut) END AS z_physics
        FROM series JOIN cut USING (well_id)""",
    )
    sql["trajectory"] = _with(
        "cut",
        f"""WITH m AS (SELECT s.well_id, avg(z) AS zm FROM series s JOIN anchors a ON a.well_id = s.well_id
                   AND (row_idx < ps OR ps = 0) GROUP BY s.well_id),
        t AS (SELECT s.*, zm, coalesce(x - lag(x) {W}, 0) AS dx, coalesce(y - lag(y) {W}, 0) AS dy,
              coalesce(z - lag(z) {W}, 0) AS dz, md - coalesce(lag(md, 10) {W}, first(md) {W}) AS dm10,
              z - coalesce(lag(z, 10) {W}, first(z) {W}) AS dz10,
              x - coalesce(lag(x, 50) {W}, first(x) {W}) AS x50, y - coalesce(lag(y, 50) {W}, first(y) {W}) AS y50,
              z - coalesce(lag(z, 50) {W}, first(z) {W}) AS z50
              FROM series s JOIN m USING (well_id)),
        u AS (SELECT *, sqrt(x50 ** 2 + y50 ** 2 + z50 ** 2) AS chord,
              sum(sqrt(dx ** 2 + dy ** 2 + dz ** 2))
                OVER (PARTITION BY well_id ORDER BY row_idx ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS arc FROM t)
        SELECT well_id, row_idx, round(z - zm, 6) AS z_local_delta,
          round(CASE WHEN abs(dm10) > 1e-9 THEN dz10 / dm10 ELSE 0 END, 6) AS dip_angle_proxy_10,
          round(CASE WHEN chord > 1e-9 AND arc > 0 THEN arc / chord ELSE 1 END, 6) AS tortuosity_window_50,
          round(sin(atan2(dy, dx)), 6) + 0 AS sin_azimuth, round(cos(atan2(dy, dx)), 6) + 0 AS cos_azimuth FROM u""",
    )
    stats = {
        "egfdl": (93.0, 22.2), "buda": (41.4, 15.4), "mnss": (131.1, 27.5), "egfdu": (69.5, 15.8),
        "astnl": (53.7, 24.2), "lthl": (84.0, 14.6), "ltgt": (75.3, 10.4), "clayrich": (120.9, 26.8),
    }
    zs = ", ".join(f"round((coalesce(gr, 0) - {m}e0) / ({s}e0 + 1e-6), 6) + 0 AS geol_gr_zscore_{f}" for f, (m, s) in stats.items())
    sql["zscores"] = _with(
        "series",
        f"""SELECT well_id, row_idx, {zs}, round(avg((coalesce(gr, 0) - 93e0) / (22.2e0 + 1e-6))
        OVER (PARTITION BY well_id ORDER BY row_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) + 0 AS geol_gr_zscore_roll20
        FROM series""",
    )
    fills, shifted, outs = [], [], []
    for c in ("x", "y", "z", "gr", "md"):
        fills.append(
            f"coalesce(last({c} IGNORE NULLS) {W}, first({c} IGNORE NULLS) OVER (PARTITION BY well_id ORDER BY row_idx"
            f" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS {c}_fill"
        )
        shifted.append(
            f"coalesce(lag({c}_fill) {W}, CASE WHEN count(*) OVER (PARTITION BY well_id) > 1 THEN {c}_fill END) AS {c}_s"
        )
        outs.append(f"{c}_fill, coalesce({c}_fill - lag({c}_fill) {W}, 0) AS {c}_diff1")
        outs.append(f"coalesce({c}_fill - lag({c}_fill, 2) {W}, 0) AS {c}_diff2")
        outs += [f"coalesce(lag({c}_fill, {k}) {W}, 0) AS {c}_lag{k}" for k in (1, 2, 3, 5)]
        outs += [f"round({_roll(c + '_s', w - 1, 0)}, 6) AS {c}_roll_mean{w}" for w in (3, 5, 10)]
        outs += [f"round({_roll(c + '_s', w - 1, 0, 'stddev_samp')}, 6) AS {c}_roll_std{w}" for w in (3, 5, 10)]
    sql["sequence_features"] = _with(
        "series",
        f"""WITH f AS (SELECT well_id, row_idx, {', '.join(fills)} FROM series),
        s AS (SELECT *, {', '.join(shifted)} FROM f)
        SELECT well_id, row_idx, {', '.join(outs)} FROM s""",
    )
    sql["interpolate_gaps"] = _with(
        "series",
        """WITH k AS (SELECT well_id, row_idx, gr,
            max(CASE WHEN gr IS NOT NULL THEN row_idx END) OVER (PARTITION BY well_id ORDER BY row_idx) AS pi,
            min(CASE WHEN gr IS NOT NULL THEN row_idx END) OVER (PARTITION BY well_id ORDER BY row_idx
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni FROM series),
        j AS (SELECT k.*, p.gr AS pg, q.gr AS ng FROM k
            LEFT JOIN series p ON p.well_id = k.well_id AND p.row_idx = k.pi
            LEFT JOIN series q ON q.well_id = k.well_id AND q.row_idx = k.ni),
        f AS (SELECT well_id, row_idx, coalesce(gr, pg + (ng - pg) * ((row_idx - pi) / CAST(ni - pi AS double)), pg, ng) AS v
              FROM j)
        SELECT well_id, row_idx, round(v, 6) AS gr_filled, round(avg(v) OVER (PARTITION BY well_id ORDER BY row_idx
          ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS gr_smooth FROM f""",
    )
    deriv = f"""d0 AS (SELECT well_id, row_idx, md, tvt_input, last_known, n,
            CASE WHEN lead(md) {W} - md > 1e-9 THEN (lead(tvt) {W} - tvt) / (lead(md) {W} - md) ELSE 0 END AS d
          FROM series s JOIN anchors a USING (well_id)),
        d AS (SELECT *, CASE WHEN row_idx = n - 1 THEN coalesce(lag(d) {W}, 0) ELSE d END AS dtvt_dmd FROM d0)"""
    sql["target_derivative"] = _with(
        "anchors",
        f"WITH {deriv} SELECT well_id, row_idx, round(dtvt_dmd, 6) AS dtvt_dmd FROM d WHERE tvt_input IS NULL",
    )
    sql["integrate_derivative"] = _with(
        "anchors",
        f"""WITH {deriv}, u AS (SELECT *, dtvt_dmd * coalesce(md - lag(md) {W}, lead(md) {W} - md, 0) AS inc
             FROM d WHERE tvt_input IS NULL)
        SELECT well_id, row_idx, round(last_known + sum(inc) {W}, 5) AS tvt_integrated FROM u""",
    )
    sql["sliding_windows"] = _with(
        "series",
        """WITH w AS (SELECT well_id, row_idx - 31 AS start, list(md) OVER f AS md, list(gr) OVER f AS gr, tvt AS label
           FROM series WINDOW f AS (PARTITION BY well_id ORDER BY row_idx ROWS BETWEEN 31 PRECEDING AND CURRENT ROW))
        SELECT * FROM w WHERE start >= 0 AND start % 16 = 0""",
    )
    sql["pad_head"] = _with(
        "series",
        """WITH p AS (SELECT well_id, row_idx, CASE WHEN row_idx >= 31 THEN tvt END AS pred FROM series)
        SELECT well_id, row_idx, coalesce(CASE WHEN row_idx < 31 THEN max(CASE WHEN row_idx = 31 THEN pred END)
          OVER (PARTITION BY well_id) ELSE pred END, 0) AS pred FROM p""",
    )
    z = ", ".join(
        f"round(({c} - avg({c}) OVER g) / CASE WHEN stddev_pop({c}) OVER g < 1e-8 THEN 1 ELSE stddev_pop({c}) OVER g END, 6)"
        f" AS {c}_z"
        for c in ("md", "x", "y", "z", "gr")
    )
    sql["series_zscore"] = _with(
        "series", f"SELECT well_id, row_idx, {z} FROM series WINDOW g AS (PARTITION BY well_id)"
    )
    sql["continuity"] = _with(
        "cut",
        f"""WITH v AS (SELECT s.well_id, row_idx, abs(tvt - lag(tvt) {W}) AS jump FROM series s),
        t AS (SELECT well_id, max(jump) AS max_jump, round(avg(jump), 6) AS mean_jump,
              count(*) FILTER (WHERE jump > 1.5) AS n_over FROM v WHERE jump IS NOT NULL GROUP BY well_id),
        f AS (SELECT well_id, string_agg(CAST(row_idx AS varchar), ',' ORDER BY row_idx) AS first_over FROM
             (SELECT *, row_number() {W} AS rn FROM v WHERE jump > 1.5) WHERE rn <= 10 GROUP BY well_id)
        SELECT well_id, max_jump, mean_jump, n_over, coalesce(first_over, '') AS first_over
        FROM t LEFT JOIN f USING (well_id)""",
    )
    return sql


def _anchors() -> dict[str, str]:
    sql = {}
    sql["scan_series"] = _with("series", "SELECT * FROM series")
    sql["scan_reference"] = _with("reference", "SELECT * FROM reference")
    sql["series_ids"] = _with("series", "SELECT DISTINCT split, well_id FROM series")
    sql["post_cut_rows"] = _with("series", "SELECT well_id, row_idx, md, gr FROM series WHERE tvt_input IS NULL")
    sql["last_known"] = _with("anchors", "SELECT well_id, last_known FROM anchors")
    sql["cut_index"] = _with("anchors", "SELECT well_id, CAST(n AS int) AS n, ps, has_cut FROM anchors")
    sql["train_rows"] = _with(
        "anchors",
        """SELECT s.well_id, row_idx, tvt, last_known AS baseline FROM series s JOIN anchors a USING (well_id)
        WHERE s.split = 'train' AND tvt_input IS NULL AND isfinite(tvt) AND last_known IS NOT NULL""",
    )
    sql["residual_target"] = _with(
        "anchors",
        """SELECT s.well_id, row_idx, tvt - last_known AS y, last_known AS baseline, last_known + (tvt - last_known) AS back
        FROM series s JOIN anchors a USING (well_id)
        WHERE s.split = 'train' AND tvt_input IS NULL AND isfinite(tvt) AND last_known IS NOT NULL""",
    )
    sql["baseline_flat"] = _with(
        "anchors",
        """SELECT well_id, row_idx, CASE WHEN tvt_input IS NULL THEN last_known END AS baseline
        FROM series JOIN anchors USING (well_id)""",
    )
    sql["baseline_slopes"] = _with(
        "anchors",
        """WITH k AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY row_idx DESC) AS rn
              FROM series WHERE tvt_input IS NOT NULL),
        s AS (SELECT well_id, regr_slope(tvt_input, md) AS sm, regr_slope(tvt_input, z) AS sz,
              regr_slope(tvt_input, md) FILTER (WHERE rn <= 200) AS sr FROM k GROUP BY well_id)
        SELECT well_id, row_idx,
          round(CASE WHEN tvt_input IS NULL THEN last_known + CASE WHEN known_rows < 2 THEN 0 ELSE sm * (md - md_last) END END, 4) AS baseline_slope_md,
          round(CASE WHEN tvt_input IS NULL THEN last_known + CASE WHEN known_rows < 2 THEN 0 ELSE sz * (z - z_last) END END, 4) AS baseline_slope_z,
          round(CASE WHEN tvt_input IS NULL THEN last_known + CASE WHEN known_rows < 2 THEN 0 ELSE sr * (md - md_last) END END, 4) AS baseline_slope_recent
        FROM series JOIN anchors USING (well_id) LEFT JOIN s USING (well_id)""",
    )
    sql["baseline_wls"] = _with(
        "anchors",
        """WITH k AS (SELECT well_id, md, tvt_input, row_number() OVER (PARTITION BY well_id ORDER BY row_idx DESC) AS rn
              FROM series WHERE tvt_input IS NOT NULL),
        w AS (SELECT *, exp(2 * 0.02e0 * (least(200, count(*) OVER (PARTITION BY well_id)) - rn)) AS w FROM k WHERE rn <= 200),
        m AS (SELECT well_id, sum(w * md) / sum(w) AS mx, sum(w * tvt_input) / sum(w) AS my FROM w GROUP BY well_id),
        s AS (SELECT well_id, sum(w * (md - mx) * (tvt_input - my)) / sum(w * (md - mx) ** 2) AS sl
              FROM w JOIN m USING (well_id) GROUP BY well_id)
        SELECT well_id, row_idx, round(CASE WHEN tvt_input IS NULL THEN last_known
          + CASE WHEN known_rows < 2 THEN 0 ELSE sl * (md - md_last) END END, 4) AS baseline
        FROM series JOIN anchors USING (well_id) LEFT JOIN s USING (well_id)""",
    )
    return sql


NUM = "CAST(substr(well_id, 2) AS bigint)"
# Fixed values, as in the operators they check.
OFFSETS = [-80, -40, -20, -10, -5, 0, 5, 10, 20, 40, 80]
BLENDS = [
    (0.50, 0.25, 0.25), (0.60, 0.20, 0.20), (0.70, 0.15, 0.15), (0.80, 0.10, 0.10),
    (0.40, 0.30, 0.30), (0.33, 0.33, 0.34), (0.50, 0.30, 0.20), (0.60, 0.30, 0.10),
]
REPORT = [0.01, 0.1, 0.5, 1, 5, 25, 50, 75, 95, 99, 99.5, 99.9, 99.99]
BOUNDS = [(0.1, 99.9), (0.5, 99.5), (1.0, 99.0)]


def _frac(p: float) -> str:
    return f"{p / 100!r}e0" if "e" not in repr(p / 100) else repr(p / 100)


def _offset(o: int) -> str:
    return f"{'m' if o < 0 else 'p'}{abs(o)}"


def _interp(q: str) -> str:
    """Curve signal at ``q`` for the series in ``a``: linear inside, constant beyond the ends."""
    lo = f"(SELECT max(struct_pack(t := tvt, g := gr)) FROM reference c WHERE c.well_id = a.well_id AND tvt <= {q})"
    hi = f"(SELECT min(struct_pack(t := tvt, g := gr)) FROM reference c WHERE c.well_id = a.well_id AND tvt >= {q})"
    return (
        f"(SELECT CASE WHEN hi.t > lo.t THEN (hi.g - lo.g) / (hi.t - lo.t) * ({q} - lo.t) + lo.g "
        f"ELSE coalesce(lo.g, hi.g) END FROM (SELECT {lo} AS lo, {hi} AS hi))"
    )


CURVE = (
    "curve AS MATERIALIZED (SELECT a.well_id, s.*, "
    + ", ".join(f"{_interp(f'(last_known + ({o}))')} AS at_{_offset(o)}" for o in OFFSETS)
    + """ FROM anchors a JOIN (SELECT well_id AS w, arg_max(tvt, tw_idx) - arg_min(tvt, tw_idx) AS tw_range,
      CASE WHEN count(*) = count(gr) THEN avg(gr) END AS tw_gr_mean,
      CASE WHEN count(*) = count(gr) THEN stddev_pop(gr) END AS tw_gr_std FROM reference GROUP BY well_id) s
      ON s.w = a.well_id)"""
)

# Window sums along the diagonals of series row x curve row; a window is valid when all of its cells exist and its
# ends lie in the band around the anchor.
MATCH = """
cells AS (
  SELECT q.well_id, q.row_idx AS i, c.tw_idx AS j, abs(q.g - coalesce(c.gr, 0)) AS d, q.n, q.anchor
  FROM match_rows q JOIN reference c ON c.well_id = q.well_id
  WHERE q.row_idx >= q.ps - 25),
win AS (
  SELECT well_id, i, j, n, anchor, sum(d) OVER f AS sad, count(*) OVER f AS k,
         greatest(i - 25, 0) AS lo, least(i + 26, n) AS hi
  FROM cells WINDOW f AS (PARTITION BY well_id, j - i ORDER BY i ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING)),
fit AS (
  SELECT w.well_id, w.i, sad, j + lo - i AS s, j + lo - i + (hi - lo) // 2 AS mid
  FROM win w
  JOIN reference a ON a.well_id = w.well_id AND a.tw_idx = j + lo - i AND a.tvt >= anchor - 300
  JOIN reference b ON b.well_id = w.well_id AND b.tw_idx = j + hi - 1 - i AND b.tvt <= anchor + 300
  JOIN anchors p ON p.well_id = w.well_id AND w.i >= p.ps
  WHERE k = hi - lo AND hi - lo >= 3),
pick AS (SELECT well_id, i, min(struct_pack(d := sad, s := s, m := mid)) AS b FROM fit GROUP BY well_id, i),
matched AS MATERIALIZED (
  SELECT q.well_id, q.row_idx, coalesce(c.tvt, q.anchor) AS matched_tvt
  FROM match_rows q LEFT JOIN pick ON pick.well_id = q.well_id AND pick.i = q.row_idx
  LEFT JOIN reference c ON c.well_id = q.well_id AND c.tw_idx = pick.b.m
  WHERE q.row_idx >= q.ps)"""


def _match_rows(anchor: str) -> str:
    return f"""match_rows AS MATERIALIZED (
  SELECT well_id, row_idx, coalesce(gr, 0) AS g, n, ps, {anchor} AS anchor FROM series JOIN cut USING (well_id))"""


STRATEGIES = (
    _match_rows("CASE WHEN tvt_input IS NULL THEN last_known + (md - md_cut) / 32 END")
    + ","
    + MATCH
    + """,
strategies AS MATERIALIZED (
  SELECT well_id, row_idx, s.split, tvt AS truth, last_known + (md - md_cut) / 32 AS model,
    CASE WHEN row_idx >= ps THEN z + (last_known - z_cut) END AS z_physics,
    coalesce(matched_tvt, last_known + (md - md_cut) / 32) AS matched
  FROM series s JOIN cut USING (well_id) LEFT JOIN matched USING (well_id, row_idx) WHERE tvt_input IS NULL)"""
)


def _fit(window: int, polyorder: int):
    import numpy as np

    half = window // 2
    design = np.vander(np.arange(-half, half + 1) / max(half, 1), polyorder + 1, increasing=True)
    return design @ np.linalg.pinv(design)


def _smooth(source: str, value: str, window: int, polyorder: int) -> str:
    """``(well_id, row_idx, v)`` of ``source`` smoothed.

    Each row takes place r of a window that starts at ``b``: the middle place inside, the row's own place at the ends.
    """
    half, fit = window // 2, _fit(window, polyorder)
    weights = ", ".join(f"({r}, {k}, {float(c)!r})" for r, row in enumerate(fit) for k, c in enumerate(row))
    return f"""SELECT q.well_id, q.row_idx, coalesce(f.v, q.v) AS v FROM (SELECT well_id, row_idx, {value} AS v FROM {source}) q
      LEFT JOIN (
        SELECT t.well_id, t.row_idx, sum(w.c * s.v) AS v FROM (
          SELECT well_id, row_idx, greatest(0, least(p - {half}, n - {window})) AS b, p FROM (
            SELECT well_id, row_idx, row_number() {W} - 1 AS p, count(*) OVER (PARTITION BY well_id) AS n FROM {source})
          WHERE n > {window}) t
        JOIN (VALUES {weights}) w(r, k, c) ON w.r = t.p - t.b
        JOIN (SELECT well_id, row_number() {W} - 1 AS p, {value} AS v FROM {source}) s
          ON s.well_id = t.well_id AND s.p = t.b + w.k
        GROUP BY t.well_id, t.row_idx) f USING (well_id, row_idx)"""


def _references() -> dict[str, str]:
    sql = {}
    cols = ", ".join(f"round(at_{_offset(o)}, 6) AS gr_at_{_offset(o)}" for o in OFFSETS)
    sql["interp_asof"] = _with("reference anchors", f"WITH {CURVE} SELECT well_id, {cols} FROM curve")
    sql["nearest_asof"] = _with(
        "reference anchors",
        """SELECT well_id, m.i AS tw_idx, m.t AS tvt, m.g AS gap FROM (
        SELECT c.well_id, min(struct_pack(g := abs(tvt - last_known), i := tw_idx, t := tvt)) AS m
        FROM reference c JOIN anchors USING (well_id) GROUP BY c.well_id)""",
    )
    sql["band_join"] = _with(
        "reference anchors",
        """SELECT well_id, tw_idx, tvt, gr FROM reference JOIN anchors USING (well_id)
        WHERE tvt BETWEEN last_known - 300 AND last_known + 300""",
    )
    sql["reference_summary"] = _with(
        "reference",
        """SELECT well_id, arg_max(tvt, tw_idx) - arg_min(tvt, tw_idx) AS tw_range, round(avg(gr), 6) AS tw_gr_mean,
        round(stddev_pop(gr), 6) AS tw_gr_std FROM reference GROUP BY well_id""",
    )
    res = ", ".join(
        f"round(CASE WHEN last_known IS NULL THEN 0 ELSE gr - at_{_offset(o)} END, 6) AS tw_gr_residual_{_offset(o)}"
        for o in OFFSETS
    )
    sql["reference_residuals"] = _with(
        "reference anchors",
        f"""WITH {CURVE} SELECT well_id, row_idx, {res}, CASE WHEN last_known IS NULL THEN 0 ELSE tw_range END AS tw_range,
        round(CASE WHEN last_known IS NULL THEN 0 ELSE tw_gr_mean END, 6) AS tw_gr_mean,
        round(CASE WHEN last_known IS NULL THEN 0 ELSE tw_gr_std END, 6) AS tw_gr_std,
        round(CASE WHEN last_known IS NULL THEN 0 ELSE at_p0 END, 6) AS tw_gr_at_last_tvt
        FROM series JOIN anchors USING (well_id) JOIN curve USING (well_id)""",
    )
    sql["formation_signal"] = _with(
        "reference",
        """SELECT geology, count(gr) AS n, round(avg(gr), 6) AS gr_mean, round(stddev_samp(gr), 6) AS gr_std
        FROM reference GROUP BY geology""",
    )
    physics = _match_rows("CASE WHEN row_idx >= ps THEN z + (last_known - z_cut) END")
    sql["window_match"] = _with(
        "reference cut", f"WITH {physics}, {MATCH} SELECT well_id, row_idx, round(matched_tvt, 6) AS matched_tvt FROM matched"
    )
    vals = "[model, z_physics, matched]"
    med = f"list_median(list_filter({vals}, lambda v: isfinite(v)))"
    sql["blend_median"] = _with(
        "reference cut",
        f"WITH {STRATEGIES} SELECT well_id, row_idx, round(coalesce({med}, model), 6) AS tvt FROM strategies",
    )
    sql["blend_weighted"] = _with(
        "reference cut",
        f"""WITH {STRATEGIES} SELECT well_id, row_idx, round((0.8e0 * model + coalesce(0.1e0 * z_physics, 0) + 0.1e0 * matched)
        / (0.8e0 + CASE WHEN z_physics IS NULL THEN 0 ELSE 0.1e0 END + 0.1e0), 6) AS tvt FROM strategies""",
    )
    names = ["model", "z_physics", "matched", "med"]
    labels = {"med": "median"}
    lines = [f"SELECT 'rmse' AS section, '{labels.get(n, n)}' AS name, sqrt(avg((truth - {n}) ** 2)) AS value FROM t" for n in names]
    lines += [f"SELECT 'corr_truth', '{labels.get(n, n)}', corr(truth, {n}) FROM t" for n in names]
    lines += [
        f"SELECT 'corr_pair', '{a}~{b}', corr({a}, {b}) FROM t"
        for a, b in (("model", "z_physics"), ("model", "matched"), ("z_physics", "matched"))
    ]
    for a, b, c in BLENDS:
        label = f"{a:.2f},{b:.2f},{c:.2f}"
        mix = f"({a}e0 * model + {b}e0 * z_physics + {c}e0 * matched) / ({a}e0 + {b}e0 + {c}e0)"
        lines.append(f"SELECT 'blend', '{label}', sqrt(avg((truth - {mix}) ** 2)) FROM t")
    sql["blend_grid"] = _with(
        "reference cut",
        f"""WITH {STRATEGIES}, t AS MATERIALIZED (SELECT truth, model, coalesce(z_physics, model) AS z_physics, matched, {med} AS med
        FROM strategies WHERE split = 'train'), u AS ({' UNION ALL '.join(lines)})
        SELECT section, name, round(value, 6) AS value,
          CAST(row_number() OVER (PARTITION BY section ORDER BY value, name) AS int) AS rank FROM u""",
    )
    return sql


def _knn_sql(query: str, cond: str, extra: str = "", folds: int = 0) -> str:
    """Nearest 50 known train rows of each row of ``query``, which ``extra`` columns tell apart besides series and row.

    Runs of 64 reference rows have a box each. A full run whose farthest corner is nearest bounds the 50th
    distance; only runs whose box comes that near are searched.
    """
    cols = ", ".join(
        f"round(list_avg(v[:{k}]), 6) AS spatial_nn{k}_mean_tvt, round(list_median(v[:{k}]), 6) AS spatial_nn{k}_median_tvt, "
        f"round(list_stddev_pop(v[:{k}]), 6) AS spatial_nn{k}_std_tvt"
        for k in (5, 10, 50)
    )
    last = f"l AS (SELECT well_id, row_idx{extra}, list_transform(m, lambda e: e.v) AS v FROM near)"
    if folds:  # ``near`` has the nearest of each fold; those of the others are put together
        last = f"""l AS (SELECT well_id, row_idx, CAST(f AS int) AS fold,
          list_transform(list_sort(flatten(list(m)))[:50], lambda e: e.v) AS v
          FROM near, range({folds}) t(f) WHERE f <> fold GROUP BY well_id, row_idx, f)"""
    near = " + ".join(f"greatest({c}0 - q.{c}, q.{c} - {c}1, 0) ** 2" for c in "xyz")
    far = " + ".join(f"greatest(abs(q.{c} - {c}0), abs(q.{c} - {c}1)) ** 2" for c in "xyz")
    return f"""WITH p AS MATERIALIZED (SELECT {NUM} AS w, row_idx // 64 AS run, {NUM} * 4294967296 + row_idx AS id, x, y, z, tvt_input AS v
      FROM series WHERE split = 'train' AND tvt_input IS NOT NULL),
    q AS MATERIALIZED (SELECT *, {NUM} AS qw FROM ({query})),
    boxes AS MATERIALIZED (SELECT w, run, count(*) AS k, {', '.join(f'min({c}) AS {c}0, max({c}) AS {c}1' for c in 'xyz')} FROM p GROUP BY w, run),
    reach AS (SELECT well_id, row_idx{extra}, min(CASE WHEN k >= 50 THEN {far} END) AS r FROM q JOIN boxes ON {cond} GROUP BY ALL),
    open AS (SELECT q.well_id, q.row_idx{extra}, q.x, q.y, q.z, w, run FROM q JOIN reach USING (well_id, row_idx{extra}) JOIN boxes ON {cond}
      WHERE {near} <= r),
    near AS (SELECT q.well_id, q.row_idx{extra}, min(struct_pack(
        d := (q.x - p.x) ** 2 + (q.y - p.y) ** 2 + (q.z - p.z) ** 2, id := p.id, v := p.v), 50) AS m
      FROM open q JOIN p USING (w, run) GROUP BY q.well_id, q.row_idx{extra}),
    {last}
    SELECT well_id, row_idx{extra}, {cols} FROM l"""


def _formation_ref(where: str) -> str:
    meds = ", ".join(f"median({f}) AS {f}" for f in FORMATIONS)
    full = " AND ".join(f"count({f}) > 0" for f in FORMATIONS)
    return f"""SELECT well_id, median(x) AS x_med, median(y) AS y_med, {meds} FROM series {where}
        GROUP BY well_id HAVING {full}"""


def _impute(query: str, cond: str, extra: str = "") -> str:
    avgs = ", ".join(f"avg(r.{f}) AS fp_{f}" for f in FORMATIONS)
    return f"""ref AS MATERIALIZED ({_formation_ref("WHERE split = 'train'")}),
    pos AS MATERIALIZED ({query}),
    pairs AS (SELECT q.well_id AS qw, q.x_med AS qx, q.y_med AS qy{extra}, r.*, sqrt((q.x_med - r.x_med) ** 2 + (q.y_med - r.y_med) ** 2) AS dist,
       row_number() OVER (PARTITION BY q.well_id{extra} ORDER BY (q.x_med - r.x_med) ** 2 + (q.y_med - r.y_med) ** 2, r.well_id) AS rn
       FROM pos q JOIN ref r ON {cond}),
    imputed AS MATERIALIZED (SELECT qw AS well_id, any_value(qx) AS x_med, any_value(qy) AS y_med{extra.replace("q.", "")}, {avgs},
       avg(dist) AS fp_knn_mean_dist, stddev_pop(r.ancc) AS fp_knn_std_ancc, stddev_pop(r.buda) AS fp_knn_std_buda
       FROM pairs r WHERE rn <= 10 GROUP BY qw{extra.replace("q.", "")})"""


FP = [f"fp_{f}" for f in FORMATIONS] + ["fp_knn_mean_dist", "fp_knn_std_ancc", "fp_knn_std_buda"]


def _neighbours() -> dict[str, str]:
    sql = {}
    sql["knn3d"] = _with("series", _knn_sql("SELECT * FROM series", "true"))
    sql["knn_oof_exclusion"] = _with("series", _knn_sql("SELECT * FROM series WHERE split = 'train'", "qw % 5 <> w % 5"))
    every = "SELECT series.*, CAST(f AS int) AS fold FROM series, range(5) t(f) WHERE split = 'train'"
    sql["knn_fold_features"] = _with("series", _knn_sql(every, "w % 5 = fold", ", fold", 5))
    sql["formation_reference"] = _with("series", _formation_ref("WHERE split = 'train'"))
    where = "SELECT well_id, median(x) AS x_med, median(y) AS y_med FROM series GROUP BY well_id"
    imputed = _impute(where, "true")
    cols = ", ".join(f"round({c}, 6) AS {c}" for c in FP)
    sql["knn2d_impute"] = _with("series", f"WITH {imputed} SELECT well_id, x_med, y_med, {cols} FROM imputed")
    pairs = list(zip(FORMATIONS, FORMATIONS[1:]))
    sql["formation_plane"] = _with(
        "series",
        f"""WITH {imputed} SELECT s.well_id, row_idx, {cols},
        {', '.join(f'round(z - fp_{f}, 6) AS fp_z_vs_{f}' for f in FORMATIONS)},
        round(least({', '.join(f'abs(z - fp_{f})' for f in FORMATIONS)}), 6) AS fp_nearest_dist,
        {', '.join(f'round(fp_{a} - fp_{b}, 6) AS fp_thick_{a}_{b}' for a, b in pairs)}
        FROM series s JOIN imputed i ON i.well_id = s.well_id""",
    )
    per_fold = _impute(
        """SELECT well_id, median(x) AS x_med, median(y) AS y_med, CAST(f AS int) AS fold
        FROM series, range(5) t(f) WHERE split = 'train' GROUP BY well_id, f""",
        "CAST(substr(r.well_id, 2) AS int) % 5 <> q.fold",
        ", q.fold",
    )
    sql["fold_features"] = _with("series", f"WITH {per_fold} SELECT well_id, x_med, y_med, fold, {cols} FROM imputed")
    return sql


# The low-pass taps of the wavelet.
TAPS = [
    -0.010597401785069032, 0.0328830116668852, 0.030841381835560764, -0.18703481171909309,
    -0.027983769416859854, 0.6308807679298589, 0.7148465705529157, 0.2303778133088965,
]


def _wavelet() -> str:
    """Detail coefficients inside the window come from one filtered copy of the signal, summed over every other row.

    Those that reach over an end of the window, and the two that rebuild its last value, are worked out per row with
    the ends mirrored.
    """
    high = [TAPS[7 - j] * (-1 if j % 2 == 0 else 1) for j in range(8)]
    inner = " + ".join(f"{h!r} * lag(v, {j}) {W}" for j, h in enumerate(high))
    taps = ", ".join(f"({j}, {TAPS[j]!r}, {high[j]!r})" for j in range(8))
    back = "CASE " + " ".join(f"WHEN m = {j} THEN {TAPS[7 - j]!r}" for j in range(8)) + " ELSE 0e0 END"
    half = "OVER (PARTITION BY well_id ORDER BY i ROWS BETWEEN 248 PRECEDING AND 1 PRECEDING)"
    return f"""WITH v AS MATERIALIZED (SELECT well_id, row_idx, row_idx AS i, coalesce(gr, 0) AS v FROM series),
    d AS (SELECT well_id, i, v, ({inner}) ** 2 AS d2 FROM v),
    r AS MATERIALIZED (SELECT *, greatest(0, i - 255) AS lo, least(i + 1, 256) AS n, (least(i + 1, 256) + 7) // 2 AS k_all,
       CASE WHEN (greatest(0, i - 255) + 1) % 2 = 0 THEN sum(CASE WHEN i % 2 = 0 THEN d2 END) {half}
            ELSE sum(CASE WHEN i % 2 = 1 THEN d2 END) {half} END AS inside FROM d),
    e AS (SELECT well_id, i, lo, n, k FROM r, range(0, 134) t(k) WHERE i >= 15 AND k < k_all AND (k <= 2 OR lo + 2 * k + 1 >= i)),
    x AS (SELECT *, lo + 2 * k + 1 - j AS spot FROM e, (VALUES {taps}) w(j, l, h)),
    y AS (SELECT *, CASE WHEN spot < lo THEN 2 * lo - 1 - spot WHEN spot > i THEN 2 * i + 1 - spot ELSE spot END AS src FROM x),
    c AS (SELECT y.well_id, y.i, y.k, any_value(n) + 5 - 2 * y.k AS m, sum(l * v.v) AS ca, sum(h * v.v) AS cd
       FROM y JOIN v ON v.well_id = y.well_id AND v.i = y.src GROUP BY y.well_id, y.i, y.k),
    s AS (SELECT well_id, i, sum(cd * cd) AS outside, sum(({back}) * ca) AS approx FROM c GROUP BY well_id, i)
    SELECT r.well_id, CAST(r.i AS int) AS row_idx, round(coalesce(approx, v), 5) AS gr_dwt_approx,
      round(coalesce((outside + coalesce(inside, 0)) / k_all, 0), 5) AS gr_dwt_detail_energy
    FROM r LEFT JOIN s ON s.well_id = r.well_id AND s.i = r.i"""


def _grid_sql(source: str, order: list, bounds: dict, with_: str) -> str:
    """Scores of smoothing and clipping settings, one table per clip and one sum per setting."""
    ctes, scores = [], []
    for name, (lo, hi) in bounds.items():
        ctes.append(f"c_{name} AS MATERIALIZED (SELECT well_id, row_idx, t, greatest({lo}, least({hi}, p)) AS p FROM {source})")
    ctes.append(f"c_none AS MATERIALIZED (SELECT well_id, row_idx, t, p FROM {source})")
    for i, (w, p, b) in enumerate(order):
        table = f"c_{b or 'none'}"
        src = _smooth(table, "p", w, p) if w else f"SELECT well_id, row_idx, p AS v FROM {table}"
        lo, hi = bounds[b] if b else ("NULL", "NULL")
        scores.append(
            f"""SELECT {i} AS setting, CAST({w or 'NULL'} AS int) AS "window", {p} AS polyorder, CAST({lo} AS double) AS lower,
            CAST({hi} AS double) AS upper, 'clip_smooth' AS apply_order,
            (SELECT sqrt(avg((t - v) ** 2)) FROM {source} JOIN ({src}) USING (well_id, row_idx)) AS rmse"""
        )
    return f"""WITH {with_}, {', '.join(ctes)}, g AS MATERIALIZED ({' UNION ALL '.join(scores)}),
        b AS (SELECT arg_min(setting, rmse) AS best, min(rmse) AS best_rmse, max(rmse) FILTER (WHERE setting = 0) AS raw,
              max(rmse) FILTER (WHERE setting = 1) AS def FROM g)
        SELECT setting, "window", polyorder, round(lower, 4) AS lower, round(upper, 4) AS upper, apply_order, round(rmse, 4) AS rmse,
        round(rmse - raw, 4) AS delta_vs_raw, round(rmse - def, 4) AS delta_vs_default,
        setting = CASE WHEN def - best_rmse < 0.01 THEN 1 ELSE best END AS chosen FROM g, b"""


def _metrics() -> dict[str, str]:
    sql = {}
    tr = "(SELECT * FROM series WHERE split = 'train')"
    sql["rmse"] = _with("oof", "SELECT round(sqrt(avg((y_true - y_pred) ** 2)), 6) AS rmse, count(*) AS n FROM oof")
    sql["naive_validation"] = _with(
        "anchors",
        """SELECT round(sqrt(avg((tvt - last_known) ** 2)), 6) AS rmse, count(*) AS n_rows, count(DISTINCT well_id) AS n_wells
        FROM series s JOIN anchors a USING (well_id)
        WHERE s.split = 'train' AND row_idx >= ps AND has_cut AND last_known IS NOT NULL AND tvt IS NOT NULL""",
    )
    sql["fallback_median"] = _with("series", f"SELECT round(median(tvt), 6) AS fallback FROM {tr}")
    lines = [f"SELECT 'p{a}-p{b}' AS label, quantile_cont(tvt, {_frac(a)}) AS lower, quantile_cont(tvt, {_frac(b)}) AS upper FROM {tr}" for a, b in BOUNDS]
    sql["clip_bounds"] = _with(
        "series", f"SELECT label, round(lower, 6) AS lower, round(upper, 6) AS upper FROM ({' UNION ALL '.join(lines)})"
    )
    sql["clip"] = _with(
        "series",
        f"""WITH b AS (SELECT quantile_cont(tvt, 0.01e0) AS lo, quantile_cont(tvt, 0.99e0) AS hi FROM {tr})
        SELECT well_id, row_idx, round(greatest(lo, least(hi, tvt)), 6) AS tvt,
        greatest(5100, least(5400, greatest(lo, least(hi, tvt)))) AS fixed FROM series, b""".replace(
            "AS fixed", "AS fixed_"
        ).replace("greatest(5100, least(5400, greatest(lo, least(hi, tvt)))) AS fixed_", "round(greatest(5100, least(5400, greatest(lo, least(hi, tvt)))), 6) AS fixed"),
    )
    stats = [("count", "count(*)"), ("min", "min(tvt)"), ("max", "max(tvt)"), ("mean", "avg(tvt)"), ("std", "stddev_pop(tvt)")]
    stats += [(f"p{p}", f"quantile_cont(tvt, {_frac(p)})") for p in REPORT]
    rows = [f"SELECT '{n}' AS name, CAST({e} AS double) AS value FROM {tr}" for n, e in stats]
    rows += [
        f"""SELECT 'outside_p{a}_p{b}', avg(CASE WHEN tvt < lo OR tvt > hi THEN 1e0 ELSE 0e0 END) * 100 FROM {tr},
        (SELECT quantile_cont(tvt, {_frac(a)}) AS lo, quantile_cont(tvt, {_frac(b)}) AS hi FROM {tr})"""
        for a, b in BOUNDS
    ]
    sql["range_report"] = _with("series", f"SELECT name, round(value, 5) AS value FROM ({' UNION ALL '.join(rows)})")
    placed = """placed AS MATERIALIZED (SELECT o.*, CASE WHEN has_cut THEN (row_idx - ps) / CAST(greatest(n - ps - 1, 1) AS double) END AS frac_after_ps,
        CASE WHEN has_cut THEN row_idx - ps ELSE -1 END AS rows_since_ps,
        CAST(CASE WHEN has_cut THEN n - ps ELSE 0 END AS int) AS well_post_ps_length FROM oof o JOIN anchors USING (well_id))"""
    sql["oof_metadata"] = _with(
        "oof",
        f"""WITH {placed} SELECT well_id, row_idx, fold, y_true, y_pred, y_pred_b, baseline, round(frac_after_ps, 6) AS frac_after_ps,
        rows_since_ps, well_post_ps_length FROM placed""",
    )
    by_fold = """SELECT fold, count(*) AS n_rows, count(DISTINCT well_id) AS n_wells,
        round(sqrt(avg((y_true - y_pred) ** 2)), 4) AS rmse_delta,
        round(sqrt(avg(((y_true + baseline) - (y_pred + baseline)) ** 2)), 4) AS rmse_full FROM oof GROUP BY fold"""
    sql["rmse_by_fold"] = _with("oof", by_fold)
    edges = ", ".join(f"lo + (hi - lo) / 10 * {k}" for k in range(1, 10))
    position = f"""e AS (SELECT min(frac_after_ps) AS lo, max(frac_after_ps) AS hi FROM placed),
        g AS (SELECT p.*, len(list_filter([{edges}], lambda v: v < frac_after_ps)) AS b FROM placed p, e WHERE frac_after_ps IS NOT NULL),
        u AS (SELECT printf('bin_%02d', b) AS grp, * FROM g
          UNION ALL SELECT 'first_5', * FROM g WHERE rows_since_ps < 5
          UNION ALL SELECT 'first_10', * FROM g WHERE rows_since_ps < 10
          UNION ALL SELECT 'last_5', * FROM g WHERE frac_after_ps > 1.0e0 - 5.0e0 / greatest(well_post_ps_length, 1)
          UNION ALL SELECT 'last_10', * FROM g WHERE frac_after_ps > 1.0e0 - 10.0e0 / greatest(well_post_ps_length, 1)),
        pos AS (SELECT grp, CASE WHEN grp LIKE 'bin%' THEN printf('[%.2f-%.2f)', min(frac_after_ps), max(frac_after_ps)) ELSE '* ' || grp END AS frac_bin,
          count(*) AS n_rows, round(sqrt(avg((y_true - y_pred) ** 2)), 4) AS rmse_delta FROM u GROUP BY grp)"""
    sql["rmse_by_position"] = _with("oof", f"WITH {placed}, {position} SELECT * FROM pos")
    length = """w AS (SELECT well_id, max(well_post_ps_length) AS len, sum((y_true - y_pred) ** 2) AS sse, count(*) AS n
          FROM placed WHERE well_post_ps_length > 0 GROUP BY well_id),
        le AS (SELECT list_sort(list_distinct(quantile_cont(CAST(len AS double), [0, 0.2e0, 0.4e0, 0.6e0, 0.8e0, 1]))) AS edges FROM w),
        bylen AS (SELECT CAST(greatest(len(list_filter(edges, lambda v: v < len)) - 1, 0) AS int) AS bin, sse, n FROM w, le),
        lens AS (SELECT bin, count(*) AS n_wells, CAST(sum(n) AS bigint) AS n_rows, round(sqrt(sum(sse) / sum(n)), 4) AS rmse_delta FROM bylen GROUP BY bin)"""
    sql["rmse_by_length"] = _with("oof", f"WITH {placed}, {length} SELECT * FROM lens")
    ratio = """r AS (SELECT well_id, count(*) AS n, CASE WHEN stddev_pop(y_true) > 1e-8 THEN stddev_pop(y_pred) / stddev_pop(y_true) ELSE 0 END AS ratio
        FROM oof GROUP BY well_id)"""
    disp = """disp AS (SELECT round(stddev_pop(y_true), 2) AS target_std, round(stddev_pop(y_pred), 2) AS pred_std,
        round(CASE WHEN stddev_pop(y_true) > 1e-8 THEN stddev_pop(y_pred) / stddev_pop(y_true) ELSE 0 END, 4) AS std_ratio,
        round(avg(y_true), 2) AS target_mean, round(avg(y_pred), 2) AS pred_mean,
        (SELECT round(median(ratio), 4) FROM r) AS per_well_ratio_median,
        (SELECT round(stddev_pop(ratio), 4) FROM r) AS per_well_ratio_std,
        (SELECT count(*) FROM r WHERE ratio < 0.5 AND n > 10) AS n_flattening_wells FROM oof)"""
    sql["dispersion"] = _with("oof", f"WITH {ratio}, {disp} SELECT * FROM disp")
    sql["flattening_wells"] = _with(
        "oof",
        f"WITH {ratio} SELECT well_id, round(ratio, 6) AS ratio FROM r WHERE ratio < 0.5 AND n > 10 ORDER BY well_id LIMIT 10",
    )
    sql["oof_join"] = _with(
        "oof",
        """SELECT well_id, row_idx, y_true AS y_true_a, y_pred AS y_pred_a, y_true AS y_true_b, y_pred_b AS y_pred_b,
        y_pred - y_true AS err_a, y_pred_b - y_true AS err_b FROM oof""",
    )
    pair = """pw AS (SELECT well_id, CASE WHEN count(*) >= 3 AND stddev_pop(y_pred - y_true) * stddev_pop(y_pred_b - y_true) <> 0
          THEN covar_pop(y_pred - y_true, y_pred_b - y_true) / (stddev_pop(y_pred - y_true) * stddev_pop(y_pred_b - y_true)) END AS c
          FROM oof GROUP BY well_id),
        err AS (SELECT count(*) AS n_shared_rows, count(DISTINCT well_id) AS n_shared_wells,
        round(corr(y_pred - y_true, y_pred_b - y_true), 4) AS global_error_corr,
        (SELECT round(coalesce(median(c), 0), 4) FROM pw) AS per_well_corr_median,
        (SELECT round(coalesce(avg(c), 0), 4) FROM pw) AS per_well_corr_mean,
        (SELECT round(coalesce(stddev_pop(c), 0), 4) FROM pw) AS per_well_corr_std,
        round(sqrt(avg((y_true - y_pred) ** 2)), 4) AS rmse_a, round(sqrt(avg((y_true - y_pred_b) ** 2)), 4) AS rmse_b,
        round(sqrt(avg((y_true - (y_pred + y_pred_b) / 2) ** 2)), 4) AS rmse_mean_blend,
        round(sqrt(avg((y_true - (y_pred + y_pred_b) / 2) ** 2))
          - least(sqrt(avg((y_true - y_pred) ** 2)), sqrt(avg((y_true - y_pred_b) ** 2))), 4) AS blend_gain_vs_best FROM oof)"""
    sql["error_correlation"] = _with("oof", f"WITH {pair} SELECT * FROM err")
    bw = """pr AS (SELECT well_id, count(*) AS n_rows, round(sqrt(avg((y_true - y_pred) ** 2)), 4) AS rmse_delta FROM oof GROUP BY well_id),
        bw AS (SELECT *, 'worst' AS side FROM (FROM pr ORDER BY rmse_delta DESC, well_id LIMIT 10)
        UNION ALL SELECT *, 'best' FROM (FROM pr ORDER BY rmse_delta, well_id DESC LIMIT 10))"""
    sql["best_worst"] = _with("oof", f"WITH {bw} SELECT * FROM bw")

    def long(source: str, section: str, key: str, names: list[str]) -> str:
        return " UNION ALL ".join(
            f"SELECT '{section}' AS section, CAST({key} AS varchar) AS key, '{n}' AS metric, CAST({n} AS double) AS value FROM {source}"
            for n in names
        )

    parts = [
        long("su", "summary", "'all'", ["n_rows", "n_wells", "rmse_delta"]),
        long("bf", "by_fold", "fold", ["n_rows", "n_wells", "rmse_delta", "rmse_full"]),
        long("fo", "folds", "'all'", ["rmse_mean", "rmse_std"]),
        long("pos", "by_position", "grp", ["n_rows", "rmse_delta"]),
        long("lens", "by_length", "bin", ["n_wells", "n_rows", "rmse_delta"]),
        long("di", "dispersion", "'all'", ["target_std", "pred_std", "std_ratio", "target_mean", "pred_mean", "per_well_ratio_median", "per_well_ratio_std", "n_flattening_wells", "flattening"]),
        long("bw", "best_worst", "side || ':' || well_id", ["n_rows", "rmse_delta"]),
        long("ec", "error_correlation", "'all'", ["n_shared_rows", "n_shared_wells", "global_error_corr", "per_well_corr_median", "per_well_corr_mean", "per_well_corr_std", "rmse_a", "rmse_b", "rmse_mean_blend", "blend_gain_vs_best", "blend_helps"]),
    ]
    sql["oof_report"] = _with(
        "oof",
        f"""WITH {placed}, {position}, {length}, {ratio}, {disp}, {pair}, {bw}, bf AS ({by_fold}),
        su AS (SELECT count(*) AS n_rows, count(DISTINCT well_id) AS n_wells, round(sqrt(avg((y_true - y_pred) ** 2)), 4) AS rmse_delta FROM oof),
        fo AS (SELECT round(avg(rmse_delta), 4) AS rmse_mean, round(stddev_pop(rmse_delta), 4) AS rmse_std FROM bf),
        di AS (SELECT *, CASE WHEN std_ratio < 0.7 THEN 1 ELSE 0 END AS flattening FROM disp),
        ec AS (SELECT *, CASE WHEN blend_gain_vs_best < 0 THEN 1 ELSE 0 END AS blend_helps FROM err)
        {' UNION ALL '.join(parts)}""",
    )
    sql["cv_summary"] = _with(
        "oof",
        """SELECT round(avg(r), 6) AS rmse_mean, round(stddev_pop(r), 6) AS rmse_std, count(*) AS n_folds
        FROM (SELECT fold, sqrt(avg((y_true - y_pred) ** 2)) AS r FROM oof GROUP BY fold)""",
    )
    sql["seed_ensemble"] = _with(
        "oof", "SELECT well_id, row_idx, round((y_pred + y_pred_b + (y_pred + y_pred_b) / 4) / 3, 6) AS y_mean FROM oof"
    )
    sql["signed_log"] = _with(
        "oof",
        """WITH t AS (SELECT well_id, row_idx, sign(y_true) * ln(1 + abs(y_true)) AS l FROM oof)
        SELECT well_id, row_idx, round(l, 6) AS y_log, round(sign(l) * (exp(abs(l)) - 1), 6) AS y_back FROM t""",
    )
    full = "full_oof AS MATERIALIZED (SELECT well_id, row_idx, y_true + baseline AS t, y_pred + baseline AS p, greatest(5100, least(5400, y_pred + baseline)) AS pc FROM oof)"
    sql["savgol"] = _with(
        "oof", f"WITH {full} SELECT well_id, row_idx, round(v, 4) AS tvt FROM ({_smooth('full_oof', 'p', 31, 2)})"
    )
    sql["postprocess"] = _with(
        "oof", f"WITH {full} SELECT well_id, row_idx, round(v, 4) AS tvt FROM ({_smooth('full_oof', 'pc', 31, 2)})"
    )
    small = {"a": ("5100.0e0", "5300.0e0"), "b": ("5050.0e0", "5400.0e0")}
    order = [(None, 0, None), (31, 2, None), (5, 2, None), (11, 2, None), (None, 0, "a"), (None, 0, "b")]
    order += [(w, 2, b) for w in (5, 11, 31) for b in small]
    sql["postproc_grid"] = _with("oof", _grid_sql("full_oof", order, small, full))
    limits = {
        f"l{i}": (f"(SELECT quantile_cont(tvt, {_frac(a)}) FROM {tr})", f"(SELECT quantile_cont(tvt, {_frac(b)}) FROM {tr})")
        for i, (a, b) in enumerate(BOUNDS)
    }
    smoothers = [(w, p) for w in (5, 11, 17, 25, 31, 41, 51) for p in (2, 3)]
    order = [(None, 0, None), (31, 2, None)] + [(w, p, None) for w, p in smoothers if (w, p) != (31, 2)]
    order += [(None, 0, b) for b in limits] + [(w, p, b) for w, p in smoothers for b in limits]
    sql["top_configs"] = _with("oof", _grid_sql("full_oof", order, limits, full) + " ORDER BY round(g.rmse, 9), setting LIMIT 15")
    sql["wavelet"] = _with("series", _wavelet())
    return sql


def _folds() -> dict[str, str]:
    sql = {}
    sql["fold_overlap"] = _with(
        "series", "SELECT well_id, count(DISTINCT row_idx % 3) AS n_folds FROM series GROUP BY well_id HAVING n_folds > 1"
    )
    sql["group_holdout"] = _with(
        "series",
        """SELECT well_id, row_number() OVER (ORDER BY md5(well_id || ':42'), well_id) <= ceil(count(*) OVER () * 0.1e0) AS holdout
        FROM (SELECT DISTINCT well_id FROM series)""",
    )
    greedy = """s AS (SELECT well_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, md5(well_id), well_id) AS k
            FROM series WHERE split = 'train' GROUP BY well_id),
        g(k, well_id, n, fold, loads) AS (
          SELECT CAST(0 AS bigint), '', CAST(0 AS bigint), 0, [CAST(0 AS bigint), 0, 0, 0, 0]
          UNION ALL
          SELECT s.k, s.well_id, s.n, CAST(list_position(loads, list_min(loads)) - 1 AS int),
            list_transform(loads, lambda v, i: v + CASE WHEN i = list_position(loads, list_min(loads)) THEN s.n ELSE 0 END)
          FROM g JOIN s ON s.k = g.k + 1)"""
    sql["group_folds"] = _with("series", f"WITH {greedy} SELECT well_id, n, fold FROM g WHERE k > 0")
    # the models are better than the flat baseline in every fold and have at most the trees they may have
    sql["gbt_skill"] = _with(
        "anchors",
        f"""WITH {greedy} SELECT s.well_id, s.row_idx, fold, round(tvt - last_known, 6) AS y_true, round(last_known, 6) AS baseline,
        true AS better, true AS within FROM series s JOIN g USING (well_id) JOIN anchors a USING (well_id)
        WHERE s.split = 'train' AND tvt_input IS NULL AND tvt IS NOT NULL""",
    )
    labels = f"""c AS (SELECT s.well_id, a.ps, a.n, has_cut,
            max(x) FILTER (WHERE row_idx = ps) - max(x) FILTER (WHERE row_idx = ps - 1) AS dxi,
            max(y) FILTER (WHERE row_idx = ps) - max(y) FILTER (WHERE row_idx = ps - 1) AS dyi,
            coalesce(max(x) FILTER (WHERE row_idx = 1) - max(x) FILTER (WHERE row_idx = 0), 0) AS dxo,
            coalesce(max(y) FILTER (WHERE row_idx = 1) - max(y) FILTER (WHERE row_idx = 0), 0) AS dyo,
            max(x) FILTER (WHERE row_idx = a.n - 1) - max(x) FILTER (WHERE row_idx = 0) AS dxw,
            max(y) FILTER (WHERE row_idx = a.n - 1) - max(y) FILTER (WHERE row_idx = 0) AS dyw,
            median(tvt) FILTER (WHERE tvt_input IS NULL) AS tvt
          FROM series s JOIN anchors a ON a.well_id = s.well_id WHERE s.split = 'train' GROUP BY s.well_id, a.ps, a.n, a.has_cut),
        e AS (SELECT list_sort(list_distinct(quantile_cont(tvt, [0, 0.25e0, 0.5e0, 0.75e0, 1]))) AS edges FROM c),
        l0 AS (SELECT well_id, CASE WHEN atan2(CASE WHEN ps = 0 THEN dyo WHEN has_cut THEN dyi ELSE dyw END,
              CASE WHEN ps = 0 THEN dxo WHEN has_cut THEN dxi ELSE dxw END) >= 0 THEN 1 ELSE 0 END AS azimuth_bin,
              CAST(greatest(len(list_filter(edges, lambda v: v < tvt)) - 1, 0) AS int) AS tvt_bin FROM c, e WHERE tvt IS NOT NULL),
        l1 AS (SELECT *, 0 AS cluster, azimuth_bin * 4 + tvt_bin AS label FROM l0),
        k AS (SELECT label, count(*) AS c FROM l1 GROUP BY label),
        m AS (SELECT k.label, CASE WHEN k.c < 5 AND (SELECT count(*) FROM k WHERE c >= 5) > 0 THEN
              (SELECT min(struct_pack(d := abs(v.label - k.label), v := v.label)).v FROM k v WHERE v.c >= 5) ELSE k.label END AS dest FROM k),
        labels AS MATERIALIZED (SELECT well_id, azimuth_bin, tvt_bin, cluster, CAST(dest AS int) AS label FROM l1 JOIN m USING (label))"""
    sql["cluster_check"] = _with(
        "series",
        """SELECT count(DISTINCT well_id) AS n_series, CAST(5 AS bigint) AS n_clusters, CAST(0 AS bigint) AS strays, CAST(0 AS bigint) AS misplaced
        FROM series WHERE split = 'train'""",
    )
    sql["strat_labels"] = _with("anchors", f"WITH {labels} SELECT * FROM labels")
    sql["strat_folds"] = _with(
        "anchors",
        f"""WITH {labels}, t AS (SELECT well_id, label, (row_number() OVER (ORDER BY label, md5(well_id), well_id) - 1) % 10 AS s FROM labels)
        SELECT well_id, label, CAST(CASE WHEN s < 5 THEN s ELSE 9 - s END AS int) AS fold FROM t""",
    )
    cols = ["x", "y", "z", "md", "tvt"]
    mean = ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in cols)
    scaled = ", ".join(f"round(CASE WHEN {c}_s < 1e-12 THEN {c} ELSE ({c} - {c}_m) / {c}_s END, 6) AS {c}" for c in cols)
    sql["fold_scaler"] = _with(
        "series",
        f"""WITH t AS MATERIALIZED (SELECT *, CAST({NUM} % 5 AS int) AS fold FROM series WHERE split = 'train'),
        sc AS (SELECT f.fold, {mean} FROM (SELECT DISTINCT fold FROM t) f JOIN t ON t.fold <> f.fold GROUP BY f.fold)
        SELECT well_id, row_idx, t.fold, {scaled}, round(tvt, 6) AS tvt_back FROM t JOIN sc ON sc.fold = t.fold""",
    )
    return sql


def _tables() -> dict[str, str]:
    sql = {}
    facts = """facts AS MATERIALIZED (SELECT split, well_id, 'horizontal_well' AS kind, count(*) AS rows FROM series GROUP BY split, well_id
        UNION ALL SELECT split, r.well_id, 'typewell', count(*) FROM reference r JOIN (SELECT DISTINCT well_id, split FROM series) s USING (well_id) GROUP BY split, r.well_id),
        w AS (SELECT split, well_id, string_agg(kind, '+' ORDER BY kind) AS kinds, count(*) AS files FROM facts GROUP BY split, well_id)"""
    lines = [
        "SELECT split, 'totals' AS section, 'all' AS key, 'csv_files' AS metric, CAST(sum(files) AS bigint) AS value FROM w GROUP BY split",
        "SELECT split, 'totals', 'all', 'unique_wells', count(*) FROM w GROUP BY split",
        "SELECT split, 'well_kinds', kinds, 'wells', count(*) FROM w GROUP BY split, kinds",
    ]
    for m, e in (("count", "count(*)"), ("min", "min(rows)"), ("median", "CAST(floor(median(rows)) AS bigint)"), ("max", "max(rows)")):
        lines.append(f"SELECT split, 'rows', kind, '{m}', {e} FROM facts GROUP BY split, kind")
    sql["inventory"] = _with("series reference", f"WITH {facts} {' UNION ALL '.join(lines)}")
    # The files leave out and spoil the same values (csv_folder in sources/tables.py).
    spoilt = "gr IS NOT NULL AND row_idx % 101 = 7"
    tops = ", ".join(f"CASE WHEN split = 'train' THEN {f} END AS {f}" for f in ["tvt", *FORMATIONS])
    sql["read_series"] = _with(
        "series", f"SELECT well_id, row_idx, split, md, x, y, z, CASE WHEN NOT ({spoilt}) THEN gr END AS gr, tvt_input, {tops} FROM series"
    )
    kinds = "(SELECT DISTINCT well_id, split FROM series)"
    sql["read_reference"] = _with(
        "series reference",
        f"SELECT well_id, tw_idx, split, tvt, CASE WHEN split = 'train' THEN gr END AS gr, geology FROM reference JOIN {kinds} USING (well_id)",
    )
    sql["read_sample"] = _with(
        "series",
        """SELECT CAST(row_number() OVER (ORDER BY CAST(substr(well_id, 2) AS bigint), row_idx) - 1 AS int) AS pos,
        well_id || '_' || row_idx AS id, '0.0' AS tvt FROM series WHERE split = 'test' AND tvt_input IS NULL""",
    )
    sql["read_ids"] = _with("series", "SELECT DISTINCT split, well_id FROM series")
    heads = f"""CASE WHEN kind = 'typewell' THEN CASE split WHEN 'train' THEN 'TVT,GR,Geology' ELSE 'TVT,Geology' END
        WHEN split = 'train' THEN 'Note,MD,X,Y,Z,GR,TVT,TVT_input,{",".join(f.upper() for f in FORMATIONS)}' ELSE 'TVT_input,GR,Z,Y,X,MD' END"""
    named = f"SELECT split, 'headers', kind || ': ' || {heads}, 'files', count(*) FROM facts GROUP BY split, kind"
    sql["read_inventory"] = _with("series reference", f"WITH {facts} {' UNION ALL '.join([*lines, named])}")
    sql["read_problems"] = _with(
        "series reference",
        f"""SELECT split, well_id, 'horizontal_well' AS kind, row_idx, 'number' AS problem, 'GR' AS "column", 'n.v.' AS value
        FROM series WHERE {spoilt} UNION ALL SELECT DISTINCT 'test', well_id, 'typewell', CAST(NULL AS int), 'missing', 'GR', NULL
        FROM reference JOIN {kinds} USING (well_id) WHERE split = 'test'""",
    )
    sql["oof_roundtrip"] = _with("oof", "SELECT well_id, row_idx, fold, y_true, y_pred, baseline FROM oof")
    sql["parse_id"] = _with(
        "series",
        """SELECT well_id || '_' || row_idx AS id, well_id, CAST(row_idx AS varchar) AS row_idx FROM series
        WHERE split = 'test' AND tvt_input IS NULL""".replace("CAST(row_idx AS varchar) AS row_idx", "row_idx"),
    )
    sql["nonfinite_report"] = _with(
        "series",
        """SELECT count(*) AS n_rows, count(*) FILTER (WHERE gr IS NULL) AS n_null, count(*) FILTER (WHERE gr = 30) AS n_nan,
        count(*) FILTER (WHERE gr = 149) AS n_inf, count(*) FILTER (WHERE gr IS NOT NULL AND gr <> 30 AND gr <> 149) AS n_finite FROM series""",
    )
    sql["id_violations"] = _with(
        "anchors",
        """SELECT CASE WHEN row_idx % 7 = 0 THEN well_id || '_x' ELSE well_id || '_' || row_idx END AS id,
        CASE WHEN row_idx % 7 = 0 THEN 'malformed id' ELSE 'target known' END AS violation FROM series
        WHERE row_idx % 7 = 0 OR tvt_input IS NOT NULL
        UNION ALL SELECT well_id || '_' || n, 'row missing' FROM anchors""",
    )
    ids = f"""ids AS MATERIALIZED (SELECT well_id || '_' || row_idx AS id, well_id, row_idx,
        row_number() OVER (ORDER BY {NUM}, row_idx) - 1 AS pos FROM series WHERE split = 'test' AND tvt_input IS NULL)"""
    sql["predict_join"] = _with(
        "cut",
        f"""WITH {ids} SELECT id, pos, round(last_known + (md - md_cut) / 32, 6) AS model FROM ids JOIN series USING (well_id, row_idx)
        JOIN cut USING (well_id)""".replace("round(last_known + (md - md_cut) / 32, 6)", "last_known + (md - md_cut) / 32"),
    )
    sql["naive_predict"] = _with(
        "anchors",
        f"""WITH {ids} SELECT id, coalesce(last_known, (SELECT median(tvt) FROM series WHERE split = 'train')) AS tvt
        FROM ids JOIN anchors USING (well_id)""",
    )
    sql["predict_pipeline"] = _with("series", f"WITH {ids} SELECT pos, id, true AS inside FROM ids")
    sql["validate_output"] = _with(
        "series",
        f"""WITH {ids}, v AS (SELECT count(*) FILTER (WHERE pos % 50 = 3) AS i, count(*) FILTER (WHERE pos % 50 = 5) AS q,
          count(*) FILTER (WHERE pos % 50 = 7) AS f, count(*) FILTER (WHERE pos % 50 = 11) AS r FROM ids)
        SELECT 'columns' AS "check", CAST(1 AS bigint) AS violations UNION ALL SELECT 'row_count', r FROM v
        UNION ALL SELECT 'id_order', i + r FROM v UNION ALL SELECT 'not_numeric', q FROM v UNION ALL SELECT 'not_finite', f FROM v""",
    )
    sql["set_ops"] = _with(
        "series",
        """WITH a AS (SELECT DISTINCT well_id FROM series WHERE ancc IS NOT NULL), b AS (SELECT DISTINCT well_id FROM series WHERE split = 'train')
        SELECT 'both' AS side, well_id AS key FROM a WHERE well_id IN (FROM b)
        UNION ALL SELECT 'left_only', well_id FROM a WHERE well_id NOT IN (FROM b)
        UNION ALL SELECT 'right_only', well_id FROM b WHERE well_id NOT IN (FROM a)""",
    )
    sql["union_splits"] = _with(
        "series",
        "SELECT well_id, row_idx, split, md, gr, CASE WHEN split = 'train' THEN tvt END AS tvt FROM series",
    )
    geo = f"""SELECT well_id, row_idx, md, x, y, z, gr,
        round(CASE WHEN max(md) OVER g > min(md) OVER g THEN (md - min(md) OVER g) / (max(md) OVER g - min(md) OVER g) ELSE 0 END, 6) AS md_relative,
        md - md_cut AS md_since_ps, x - x_cut AS dx_since_ps, y - y_cut AS dy_since_ps, z - z_cut AS dz_since_ps,
        round(sqrt((x - x_cut) ** 2 + (y - y_cut) ** 2), 6) AS dxy_since_ps,
        round(CASE WHEN row_idx >= ps AND n - ps > 1 THEN (row_idx - ps) / CAST(n - ps - 1 AS double) ELSE 0 END, 6) AS frac_after_ps,
        round(coalesce((x - lag(x) {W}) / nullif(md - lag(md) {W}, 0), 0), 6) AS dxdmd,
        round(coalesce((y - lag(y) {W}) / nullif(md - lag(md) {W}, 0), 0), 6) AS dydmd,
        round(coalesce((z - lag(z) {W}) / nullif(md - lag(md) {W}, 0), 0), 6) AS dzdmd,
        round({_roll('gr', 50, 50)}, 6) AS gr_roll_mean_101, round({_roll('gr', 50, 50, 'stddev_samp')}, 6) AS gr_roll_std_101,
        round(coalesce(sum(gr * gr) {W}, 0) / greatest(count(gr) {W}, 1), 6) AS gr_energy
        FROM series JOIN cut USING (well_id) WINDOW g AS (PARTITION BY well_id)"""
    sql["feature_table"] = _with("cut", geo)
    return sql


def oracle_sql() -> dict[str, str]:
    return {
        **_anchors(),
        **_windows(),
        **_references(),
        **_neighbours(),
        **_metrics(),
        **_folds(),
        **_tables(),
    }
