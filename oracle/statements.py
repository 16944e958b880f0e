"""One SQL statement per registered query that SQL can express."""

from __future__ import annotations

from oracle import parts as p
from oracle.parts import END, EPOCH, bdiff, dest_lat, dest_lon, enu_e, enu_n, hav, part, pmod, statement

STATEMENTS: dict[str, str] = {}


def stmt(name: str, body: str, *needs: str) -> None:
    STATEMENTS[name] = statement(body, *needs)


def rnd(digits: int, *cols: str) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols)


def label(x: str) -> str:
    return f"('sector-' || {x})"


# -- shared parts -----------------------------------------------------------


def picture(src: str, end: str = END) -> str:
    return f"""
SELECT * EXCLUDE (next_us, f, u, gone), unnest(generate_series(f, u, 1000000)) AS tick_us FROM (
 SELECT *, CASE WHEN (next_us IS NULL OR gone < next_us) AND gone <= {end} THEN gone END AS vanish_tick_us,
  (t_us+999999)//1000000*1000000 AS f,
  least({end}, (t_us+15000000)//1000000*1000000, coalesce(((next_us+999999)//1000000-1)*1000000, {end})) AS u
 FROM (SELECT *, lead(t_us) OVER (PARTITION BY scenario_id, track_id ORDER BY t_us) AS next_us,
         ((t_us+15000000)//1000000+1)*1000000 AS gone FROM {src}) WHERE state <> 'terminated') WHERE f <= u"""


part("pic", picture("trk"), "trk")
part("rpic", picture("upd"), "upd")


def kin(src: str) -> str:
    return f"""
SELECT k.*, o.ref_lat, o.ref_lon, {enu_e('ref_lat', 'ref_lon', 'lat', 'lon')} AS ee, {enu_n('ref_lat', 'lat')} AS nn,
  ground_speed_kt*sin(radians(track_deg)) AS ve, ground_speed_kt*cos(radians(track_deg)) AS vn,
  position_uncertainty_m/1852.0/sqrt(2.0) AS ps, velocity_uncertainty_kt AS vs, altitude_uncertainty_ft AS zs,
  vertical_rate_uncertainty_fpm AS ws
FROM (SELECT * FROM {src} WHERE update_count >= 5) k
JOIN (SELECT scenario_id, tick_us, avg(lat) AS ref_lat, avg(lon) AS ref_lon, count(*) AS tracks
      FROM {src} WHERE update_count >= 5 GROUP BY ALL) o USING (scenario_id, tick_us)"""


part("kin", kin("pic"), "pic")
part("rkin", kin("rpic"), "rpic")


def pairs(src: str, lookaheads: str = "(300.0)") -> str:
    """All pairs of a scan with their closest approach: the exhaustive scan."""
    return f"""
SELECT *, sqrt(power(re+rve*tc,2)+power(rn+rvn*tc,2)) AS minh, abs(rz+rvz*tc) AS minv,
  sqrt(re*re+rn*rn) AS curh, abs(rz) AS curv FROM (
 SELECT *, CASE WHEN rve*rve+rvn*rvn < 1e-12 THEN 0.0
   ELSE greatest(0.0, least(lookahead_s, -(re*rve+rn*rvn)/(rve*rve+rvn*rvn))) END AS tc FROM (
  SELECT a.scenario_id, a.tick_us, a.track_id AS first_track_id, b.track_id AS second_track_id,
   a.callsign AS first_callsign, b.callsign AS second_callsign, CAST(l.x AS DOUBLE) AS lookahead_s,
   least(a.vanish_tick_us, b.vanish_tick_us) AS vanish_tick_us,
   b.ee-a.ee AS re, b.nn-a.nn AS rn, (b.ve-a.ve)/3600.0 AS rve, (b.vn-a.vn)/3600.0 AS rvn,
   b.altitude_ft-a.altitude_ft AS rz, (b.vertical_rate_fpm-a.vertical_rate_fpm)/60.0 AS rvz,
   a.ps AS aps, b.ps AS bps, a.vs AS avs, b.vs AS bvs, a.zs AS azs, b.zs AS bzs, a.ws AS aws, b.ws AS bws
  FROM {src} a JOIN {src} b ON a.scenario_id=b.scenario_id AND a.tick_us=b.tick_us AND a.track_id<b.track_id
  CROSS JOIN (VALUES {lookaheads}) l(x))
  WHERE abs(rz) - abs(rvz)*lookahead_s - {{slack}} < 1000.0)"""


_SLACK = "9.0*sqrt(azs*azs+bzs*bzs+(aws*aws+bws*bws)/3600.0*lookahead_s*lookahead_s)"
part("con", f"SELECT * FROM ({pairs('kin').format(slack='0.0')}) WHERE minh < 5.0 AND minv < 1000.0", "kin")
part("rcon", f"SELECT * FROM ({pairs('rkin').format(slack='0.0')}) WHERE minh < 5.0 AND minv < 1000.0", "rkin")
part(
    "rconl",
    f"SELECT * FROM ({pairs('rkin', '(60.0),(120.0),(180.0),(240.0),(300.0)').format(slack='0.0')}) WHERE minh < 5.0 AND minv < 1000.0",
    "rkin",
)


def erf(x: str) -> str:
    """Error function of a column by its all-positive series (|x| <= 7 is exact to rounding)."""
    a = f"least(abs({x}), 7.0)"
    return (
        f"(sign({x})*least(1.0, exp(-{a}*{a})*list_sum(list_transform(range(0, 160), "
        f"lambda n: CASE WHEN {a} = 0.0 THEN 0.0 ELSE exp((2*n+1)*ln({a}) - lgamma(n+1.5)) END))))"
    )


def scored(src: str) -> str:
    """P(both standards breached): the disc as a race of two Poisson variables, in logs."""
    return f"""
SELECT q.*, CASE WHEN ua - ub > 9.0 THEN 0.0 WHEN ub - ua > 9.0 THEN 1.0 ELSE d.disc END *
  greatest(0.0, 0.5*({erf('((1000.0-minv)/sv/sqrt(2.0))')} - {erf('((-1000.0-minv)/sv/sqrt(2.0))')})) AS prob
FROM q LEFT JOIN (
  SELECT id, sum(exp(CASE WHEN ma > 0 THEN j*ln(ma)-ma-lgamma(j+1) WHEN j = 0 THEN 0.0 ELSE -1e9 END) * surv) AS disc FROM (
    SELECT id, j, ma, coalesce(sum(exp(j*ln(mb)-mb-lgamma(j+1))) OVER (PARTITION BY id ORDER BY j DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS surv
    FROM (SELECT id, 0.5*ua*ua AS ma, 0.5*ub*ub AS mb,
            unnest(generate_series(CAST(greatest(0, floor(least(0.5*ua*ua,0.5*ub*ub)-14*sqrt(0.5*ub*ub+0.5*ua*ua+1)-10)) AS BIGINT),
              CAST(ceil(greatest(0.5*ua*ua,0.5*ub*ub)+14*sqrt(greatest(0.5*ua*ua,0.5*ub*ub)+1))+10 AS BIGINT))) AS j
          FROM q WHERE abs(ua-ub) <= 9.0)) GROUP BY id) d ON d.id = q.id"""


def scored_parts(tag: str, src: str) -> None:
    part(
        f"q{tag}",
        f"""SELECT *, minh/sh AS ua, 5.0/sh AS ub FROM (
 SELECT *, row_number() OVER () AS id,
  sqrt(aps*aps+bps*bps+((avs/3600.0)*(avs/3600.0)+(bvs/3600.0)*(bvs/3600.0))*tc*tc) AS sh,
  sqrt(azs*azs+bzs*bzs+((aws/60.0)*(aws/60.0)+(bws/60.0)*(bws/60.0))*tc*tc) AS sv
 FROM ({pairs(src).format(slack=_SLACK)})) WHERE minh - 5.0 <= 9.0*sh""",
        src,
    )
    part(f"sc{tag}", scored(src).replace("FROM q ", f"FROM q{tag} q "), f"q{tag}")


scored_parts("l", "kin")
scored_parts("r", "rkin")

# -- tracking ---------------------------------------------------------------

_STATE = ["lat", "lon", "altitude_ft", "ground_speed_kt", "track_deg", "vertical_rate_fpm", "turn_rate_deg_s", "innovation_nm"]
_SIGMA = ["position_uncertainty_m", "velocity_uncertainty_kt", "altitude_uncertainty_ft", "vertical_rate_uncertainty_fpm"]
stmt("j01_track_estimates", f"SELECT scenario_id, icao24, track_id, t_us, update_count, state, callsign, squawk, {rnd(6, *_STATE, *_SIGMA)} FROM upd", "upd")
stmt("j02_lifecycle_transitions", "SELECT scenario_id, icao24, t_us, last_report_us, state, update_count FROM trk WHERE state IN ('coasting','terminated')", "trk")
stmt("j03_coasting_growth", f"SELECT scenario_id, icao24, t_us, {rnd(4, 'lat', 'lon', *_SIGMA)}, {rnd(3, 'altitude_ft')} FROM trk WHERE state = 'coasting'", "trk")
stmt("j04_late_reports_dropped", "SELECT scenario_id, icao24, count(*) AS n, max(update_count) AS max_count, round(sum(ground_speed_kt), 3) AS speed_sum FROM upd GROUP BY ALL", "upd")
stmt("f02_turn_rate", f"SELECT scenario_id, icao24, t_us, {rnd(5, 'turn_rate_deg_s')} FROM upd", "upd")
stmt("f03_update_counts", "SELECT scenario_id, icao24, segment_us, max(update_count) AS updates, count(*) FILTER (state='confirmed') AS confirmed FROM upd GROUP BY ALL", "upd")
stmt("f04_flight_segments", "SELECT scenario_id, icao24, segment_us, count(*) AS n, max(t_us) AS last_us FROM seg GROUP BY ALL", "seg")
stmt("c06_order_guard", "SELECT scenario_id, count(*) AS kept, count(DISTINCT (icao24, t_us)) AS instants FROM seg GROUP BY ALL", "seg")

# -- picture and conflicts --------------------------------------------------

stmt("d04_tick_picture", f"SELECT scenario_id, track_id, tick_us, t_us, state, update_count, {rnd(6, 'lat', 'lon')}, vanish_tick_us FROM pic", "pic")
stmt("f09_validity_intervals", """
SELECT scenario_id, track_id, t_us, (t_us+999999)//1000000*1000000 AS from_tick_us,
 least((t_us+15000000)//1000000*1000000, coalesce(((next_us+999999)//1000000-1)*1000000, 9000000000000000)) AS until_tick_us,
 CASE WHEN next_us IS NULL OR gone < next_us THEN gone END AS vanish_tick_us
FROM (SELECT *, lead(t_us) OVER (PARTITION BY scenario_id, track_id ORDER BY t_us) AS next_us,
  ((t_us+15000000)//1000000+1)*1000000 AS gone FROM trk) WHERE state <> 'terminated'""", "trk")
stmt("c04_stale_expiry", f"""
SELECT scenario_id, track_id, gone AS tick_us, t_us AS last_update_us
FROM (SELECT *, lead(t_us) OVER (PARTITION BY scenario_id, track_id ORDER BY t_us) AS next_us,
  ((t_us+15000000)//1000000+1)*1000000 AS gone FROM trk)
WHERE state <> 'terminated' AND (next_us IS NULL OR gone < next_us) AND gone <= {END}""", "trk")
stmt("h03_vanished_tracks", f"""
SELECT a.scenario_id, a.track_id, a.tick_us+1000000 AS tick_us FROM pic a WHERE a.tick_us < {END} AND NOT EXISTS (
 SELECT 1 FROM pic b WHERE b.scenario_id=a.scenario_id AND b.track_id=a.track_id AND b.tick_us=a.tick_us+1000000)""", "pic")
stmt("c01_eligible_tracks", "SELECT scenario_id, tick_us, count(*) AS n, min(update_count) AS least FROM pic WHERE update_count >= 5 GROUP BY ALL", "pic")
stmt("e01_frame_origins", """
SELECT scenario_id, tick_us, round(any_value(kin.ref_lat),5)+0.0 AS ref_lat, round(any_value(kin.ref_lon),5)+0.0 AS ref_lon,
 count(*) AS tracks, round(max(sqrt(ee*ee+nn*nn)),5)+0.0 AS radius_nm, max(sqrt(ee*ee+nn*nn)) > 300.0 AS too_wide
FROM kin GROUP BY scenario_id, tick_us""", "kin")
_CON = "round(tc,4)+0.0 AS time_to_cpa_s, round(minh,4)+0.0 AS min_horizontal_nm, round(minv,4)+0.0 AS min_vertical_ft, round(curh,4)+0.0 AS current_horizontal_nm, round(curv,4)+0.0 AS current_vertical_ft"
stmt("d01_conflict_pairs", f"SELECT scenario_id, tick_us, first_track_id, second_track_id, {_CON} FROM con", "con")
stmt("d02_probable_conflicts", "SELECT scenario_id, tick_us, first_track_id, second_track_id, round(prob,5)+0.0 AS probability FROM scl WHERE prob >= 0.35", "scl")
_CODES = """array_to_string(list_filter(['horizontal_below_standard','vertical_below_standard',
 CASE WHEN tc <= 0.0 THEN 'already_in_conflict' WHEN tc < 60.0 THEN 'imminent' END,
 CASE WHEN curh < 5.0 THEN 'currently_within_horizontal_standard' END], lambda x: x IS NOT NULL), ',')"""
_SEV = "CASE WHEN tc <= 60.0 THEN 'warning' WHEN tc <= 180.0 THEN 'caution' ELSE 'advisory' END"
_SUM = "format('{} and {}: predicted separation {:.1f} NM / {:.0f} ft in {:.0f} s', coalesce(first_callsign, first_track_id), coalesce(second_callsign, second_track_id), minh, minv, tc)"
_KEY = "'predicted_conflict:' || first_track_id || ':' || second_track_id"
stmt("b21_conflict_labels", f"SELECT scenario_id, tick_us, {_KEY} AS alert_key, {_SEV} AS severity, {_CODES} AS reason_codes, {_SUM} AS summary FROM con", "con")
stmt("g01_soonest_first", "SELECT scenario_id, tick_us, first_track_id, second_track_id, round(tc,4)+0.0 AS time_to_cpa_s FROM con ORDER BY tc", "con")

part("sqk", """
SELECT scenario_id, tick_us, track_id, vanish_tick_us, 'emergency_squawk' AS kind, 'warning' AS severity,
 format('{} squawking {} ({})', coalesce(callsign, icao24), squawk, CASE squawk WHEN '7500' THEN 'unlawful interference' WHEN '7600' THEN 'radio failure' ELSE 'general emergency' END) AS summary,
 CASE squawk WHEN '7500' THEN 'squawk_7500_hijack' WHEN '7600' THEN 'squawk_7600_radio_failure' ELSE 'squawk_7700_emergency' END AS reason_codes
FROM pic WHERE squawk IN ('7500','7600','7700')""", "pic")
part("desc_", """
SELECT scenario_id, tick_us, track_id, vanish_tick_us, 'excessive_descent' AS kind,
 CASE WHEN altitude_ft < 10000.0 AND vertical_rate_fpm <= -3000.0 THEN 'warning' ELSE 'caution' END AS severity,
 format('{} descending at {:,} fpm through {:,} ft', coalesce(callsign, icao24), CAST(abs(round_even(vertical_rate_fpm,0)) AS BIGINT), CAST(round_even(altitude_ft,0) AS BIGINT)) AS summary,
 concat_ws(',', CASE WHEN vertical_rate_fpm <= -6000.0 THEN 'descent_rate_above_6000_fpm' END,
   CASE WHEN altitude_ft < 10000.0 AND vertical_rate_fpm <= -3000.0 THEN 'steep_descent_below_10000_ft' END) AS reason_codes
FROM pic WHERE vertical_rate_fpm <= -6000.0 OR (altitude_ft < 10000.0 AND vertical_rate_fpm <= -3000.0)""", "pic")
stmt("c02_emergency_squawks", "SELECT scenario_id, tick_us, track_id, severity, summary, reason_codes FROM sqk", "sqk")
stmt("c03_excessive_descents", "SELECT scenario_id, tick_us, track_id, severity, summary, reason_codes FROM desc_", "desc_")

# -- conformance ------------------------------------------------------------


def checked(src: str) -> str:
    d = "ground_speed_kt/3600.0*60.0"
    return f"""
SELECT x.scenario_id, x.track_id, x.icao24, x.t_us AS predicted_us, y.t_us AS matched_us, y.callsign,
  {hav('x.plat', 'x.plon', 'y.lat', 'y.lon')} AS error_nm FROM (
 SELECT r.*, (SELECT min(u.t_us) FROM run u WHERE u.scenario_id=r.scenario_id AND u.track_id=r.track_id
     AND u.t_us BETWEEN r.t_us+57000000 AND r.t_us+63000000) AS m_us,
   {dest_lat('lat', 'track_deg', d)} AS plat, {dest_lon('lat', 'lon', 'track_deg', d)} AS plon FROM run r) x
JOIN run y ON y.scenario_id=x.scenario_id AND y.track_id=x.track_id AND y.t_us=x.m_us AND y.run_no=x.run_no"""


def run(src: str) -> str:
    return f"""
SELECT *, sum(CASE WHEN gone < t_us THEN 1 ELSE 0 END) OVER (PARTITION BY scenario_id, track_id ORDER BY t_us) AS run_no
FROM (SELECT *, ((lag(t_us) OVER (PARTITION BY scenario_id, track_id ORDER BY t_us)+15000000)//1000000+1)*1000000 AS gone
      FROM {src} WHERE state <> 'terminated')"""


def conformance_parts(tag: str, src: str, pic: str) -> None:
    part(f"run{tag}", run(src), src)
    part(f"chk{tag}", checked(src).replace("FROM run ", f"FROM run{tag} ").replace("JOIN run ", f"JOIN run{tag} "), f"run{tag}")
    part(f"dev{tag}", f"""
SELECT * FROM chk{tag} WHERE error_nm > 3.0*2.412
QUALIFY row_number() OVER (PARTITION BY scenario_id, track_id, matched_us ORDER BY error_nm DESC, predicted_us) = 1""", f"chk{tag}")
    part(f"scan{tag}", f"""
SELECT d.*, q.vanish_tick_us FROM (
 SELECT *, (matched_us+999999)//1000000*1000000 AS tick_us FROM dev{tag}
 QUALIFY row_number() OVER (PARTITION BY scenario_id, track_id, (matched_us+999999)//1000000 ORDER BY matched_us DESC) = 1) d
LEFT JOIN {pic} q USING (scenario_id, track_id, tick_us)""", f"dev{tag}", pic)


conformance_parts("l", "trk", "pic")
conformance_parts("r", "upd", "rpic")
stmt("d05_matured_predictions", "SELECT scenario_id, track_id, predicted_us, matched_us, round(error_nm,4)+0.0 AS error_nm, round(error_nm,4)+0.0 AS baseline_error_nm FROM chkl", "chkl")
stmt("k10_calibrated_thresholds", "SELECT 'dead_reckoning' AS source, 60.0::DOUBLE AS horizon_s, 2.412::DOUBLE*3.0::DOUBLE AS threshold_nm, count(*) AS n, count(*) FILTER (error_nm > 3.0*2.412) AS over FROM chkl", "chkl")
stmt("e02_worst_deviation", "SELECT scenario_id, track_id, matched_us, predicted_us, round(error_nm,4)+0.0 AS error_nm, round(3.0*2.412,4)::DOUBLE AS threshold_nm FROM devl", "devl")
_DSUM = "format('{} diverged {:.1f} NM from its 60 s prediction (threshold 7.2 NM). Advisory only: no flight plan is available, so this may be an entirely normal manoeuvre.', coalesce(callsign, track_id), error_nm)"
_DCODES = "concat_ws(',', 'prediction_error_above_threshold', 'physics_prediction_only', CASE WHEN error_nm > 2.0*3.0*2.412 THEN 'large_deviation' END)"
stmt("b22_deviation_labels", f"SELECT scenario_id, tick_us, 'non_conformance:' || track_id AS alert_key, 'advisory' AS severity, {_DCODES} AS reason_codes, {_DSUM} AS summary FROM scanl", "scanl")

# -- alerts -----------------------------------------------------------------

part("det", f"""
SELECT scenario_id, tick_us, vanish_tick_us, {_KEY} AS alert_key, 'predicted_conflict' AS kind, {_SEV} AS severity, {_SUM} AS summary, {_CODES} AS reason_codes, first_track_id || ',' || second_track_id AS track_ids FROM con
UNION ALL SELECT scenario_id, tick_us, vanish_tick_us, kind || ':' || track_id, kind, severity, summary, reason_codes, track_id FROM (SELECT * FROM sqk UNION ALL SELECT * FROM desc_)
UNION ALL SELECT scenario_id, tick_us, vanish_tick_us, 'non_conformance:' || track_id, 'non_conformance', 'advisory', {_DSUM}, {_DCODES}, track_id FROM scanl""",
     "con", "sqk", "desc_", "scanl")


def islands(src: str, arm: str = "") -> str:
    k = f"{arm}scenario_id, alert_key"
    return f"""
SELECT *, max(CASE WHEN opens THEN tick_us END) OVER (PARTITION BY {k} ORDER BY tick_us) AS raised_us,
  CASE WHEN ends THEN least(tick_us+3000000, vanish_tick_us) END AS clear_us FROM (
 SELECT *, p_us IS NULL OR tick_us-p_us >= 4000000 OR coalesce(p_gone < tick_us, false) AS opens,
  n_us IS NULL OR n_us-tick_us >= 4000000 OR coalesce(vanish_tick_us < n_us, false) AS ends FROM (
  SELECT *, lag(tick_us) OVER w AS p_us, lag(vanish_tick_us) OVER w AS p_gone, lead(tick_us) OVER w AS n_us
  FROM {src} WINDOW w AS (PARTITION BY {k} ORDER BY tick_us)))"""


part("isl", islands("det"), "det")
part("nxt", """
SELECT a.scenario_id, a.alert_key, a.raised_us, a.tick_us, min(b.tick_us) AS next_us FROM isl a
JOIN isl b ON b.scenario_id=a.scenario_id AND b.alert_key=a.alert_key AND b.raised_us=a.raised_us AND b.tick_us BETWEEN a.tick_us+10000000 AND a.tick_us+12000000
GROUP BY ALL""", "isl")
part("beat", """
SELECT n.scenario_id, n.alert_key, n.raised_us, n.next_us AS tick_us FROM nxt n WHERE n.tick_us = n.raised_us
UNION ALL
SELECT n.scenario_id, n.alert_key, n.raised_us, n.next_us FROM beat b JOIN nxt n
 ON n.scenario_id=b.scenario_id AND n.alert_key=b.alert_key AND n.raised_us=b.raised_us AND n.tick_us=b.tick_us""", "nxt")
part("life", f"""
SELECT *, tick_us AS updated_us, 'new' AS st FROM isl WHERE opens
UNION ALL SELECT i.*, i.tick_us, 'sustained' FROM isl i JOIN beat b USING (scenario_id, alert_key, raised_us, tick_us)
UNION ALL SELECT *, clear_us, 'cleared' FROM isl WHERE clear_us <= {END}""", "isl", "beat")
stmt("h01_detection_union", """
SELECT scenario_id, kind, severity, count(*) AS n, count(*) FILTER (kind='predicted_conflict') AS with_conflict,
 count(*) FILTER (kind='non_conformance') AS with_conformance, min(tick_us) AS first_us FROM det GROUP BY scenario_id, kind, severity""", "det")
part("conh", f"SELECT * FROM ({pairs('kin', '(120.0),(300.0)').format(slack='0.0')}) WHERE minh < 5.0 AND minv < 1000.0", "kin")
stmt("h02_last_detection_wins", f"""
SELECT scenario_id, {_KEY} AS alert_key, tick_us, lookahead_s, {_SEV} AS severity FROM conh
QUALIFY row_number() OVER (PARTITION BY scenario_id, first_track_id, second_track_id, tick_us ORDER BY lookahead_s DESC) = 1""", "conh")
stmt("f06_alert_islands", "SELECT scenario_id, alert_key, raised_us, count(*) AS n, max(tick_us) AS last_us, max(clear_us) AS clear_us FROM isl GROUP BY ALL", "isl")
stmt("j09_alert_lifecycle", """
SELECT scenario_id, sha256(scenario_id || '|' || alert_key || '|' || CAST(raised_us AS VARCHAR)) AS alert_id, alert_key, kind, severity, st AS state, raised_us, updated_us,
 CASE WHEN st='cleared' THEN 'Cleared: ' || summary ELSE summary END AS summary, track_ids, reason_codes FROM life""", "life")
stmt("d14_cleared_by_vanish", """
SELECT l.scenario_id, l.alert_key, g.track_id, l.updated_us FROM (SELECT *, unnest(string_split(track_ids, ',')) AS track_id FROM life WHERE st='cleared') l
JOIN (SELECT DISTINCT scenario_id, track_id, vanish_tick_us FROM pic WHERE vanish_tick_us IS NOT NULL) g
 ON g.scenario_id=l.scenario_id AND g.track_id=l.track_id AND g.vanish_tick_us=l.updated_us""", "life", "pic")

# -- truth and evaluation ---------------------------------------------------


def raised(tag: str, con: str, arm: str = "", dep: str | None = None) -> None:
    a = f"{arm}, " if arm else ""
    part(f"rd{tag}", f"SELECT {a}scenario_id, tick_us, vanish_tick_us, {_KEY} AS alert_key, first_track_id, second_track_id, tc, minh, minv FROM {con}", dep or con)
    part(f"ri{tag}", islands(f"rd{tag}", a), f"rd{tag}")
    part(f"raised{tag}", f"""
SELECT {a}scenario_id, alert_key, substr(first_track_id,5) AS a, substr(second_track_id,5) AS b, tick_us AS raised_us, tc, minh, minv
FROM ri{tag} WHERE opens QUALIFY row_number() OVER (PARTITION BY {a}scenario_id, alert_key ORDER BY tick_us) = 1""", f"ri{tag}")


raised("", "rcon")
raised("k", "rconl", "lookahead_s")
part("vio", f"""
SELECT scenario_id, sec, a.icao24 AS a, b.icao24 AS b, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS h, abs(a.altitude_ft-b.altitude_ft) AS v
FROM tru a JOIN tru b USING (scenario_id, sec) WHERE a.icao24 < b.icao24 AND abs(a.altitude_ft-b.altitude_ft) < 1000.0
 AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} < 5.0""", "tru")
part("evt", """
SELECT scenario_id, a, b, CAST(event_no AS INT) AS event_no, min(sec) AS started_s, max(sec) AS ended_s, min(h) AS minh, min(v) AS minv FROM (
 SELECT *, sum(o) OVER (PARTITION BY scenario_id, a, b ORDER BY sec) AS event_no FROM (
  SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY scenario_id, a, b ORDER BY sec) <= 30 THEN 0 ELSE 1 END AS o FROM vio))
GROUP BY ALL""", "vio")
stmt("d06_truth_violations", "SELECT scenario_id, sec, a AS first_icao24, b AS second_icao24, round(h,4)+0.0 AS horizontal_nm, round(v,4)+0.0 AS vertical_ft FROM vio", "vio")
stmt("e03_truth_events", "SELECT scenario_id, a AS first_icao24, b AS second_icao24, event_no, started_s, ended_s, round(minh,4)+0.0 AS min_horizontal_nm, round(minv,4)+0.0 AS min_vertical_ft FROM evt", "evt")
stmt("f05_event_islands", "SELECT scenario_id, count(*) AS events, max(event_no) AS most, sum(ended_s-started_s) AS seconds FROM evt GROUP BY ALL", "evt")
stmt("g06_events_by_start", "SELECT scenario_id, a AS first_icao24, b AS second_icao24, started_s FROM evt ORDER BY started_s, scenario_id, a, b", "evt")
_MATCH = f"""SELECT e.*, r.alert_key, r.raised_us, coalesce(r.raised_us <= {EPOCH}+e.started_s*1000000, false) AS detected,
 CASE WHEN r.raised_us <= {EPOCH}+e.started_s*1000000 THEN ({EPOCH}+e.started_s*1000000-r.raised_us)/1000000.0 END AS lead_s"""
part("mat", f"{_MATCH} FROM evt e LEFT JOIN raised r USING (scenario_id, a, b)", "evt", "raised")
stmt("f08_first_new_alert", "SELECT scenario_id, alert_key, a AS first_icao24, b AS second_icao24, raised_us FROM raised", "raised")
stmt("d07_matched_events", "SELECT scenario_id, a AS first_icao24, b AS second_icao24, started_s, detected, round(lead_s,3) AS lead_s FROM mat", "mat")
part("fals", "SELECT * FROM raised r WHERE NOT EXISTS (SELECT 1 FROM evt e WHERE e.scenario_id=r.scenario_id AND e.a=r.a AND e.b=r.b)", "raised", "evt")
stmt("d08_false_alerts", "SELECT scenario_id, alert_key, raised_us FROM fals", "fals")
part("scn", f"""
SELECT scenario_id, ({END}-{EPOCH})/1000000.0 AS duration_s, CASE WHEN s % 2 = 0 THEN 'nominal' ELSE 'shifted' END AS family,
 round(count(*) FILTER (i % 3 = 0)/count(*), 2) AS density FROM act GROUP BY scenario_id, s""", "act")
_LEADS = """list_sort(list(lead_s)) AS ls"""
_LCOLS = """coalesce(len(ls),0) AS lead_count,
 round(CASE WHEN len(ls) % 2 = 1 THEN ls[len(ls)//2+1] ELSE (ls[len(ls)//2]+ls[len(ls)//2+1])/2.0 END, 1) AS lead_median_s,
 CASE WHEN len(ls) >= 10 THEN round(ls[len(ls)//10+1],1) END AS lead_p10_s, round(ls[1],1) AS lead_min_s, round(ls[len(ls)],1) AS lead_max_s"""


def scorecard(group: str, arms_from: str, raised_part: str, match_arm: str = "") -> str:
    """Scorecard by `group` columns; arms_from yields one row per (scenario, arm)."""
    g = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    using = f"USING ({group})" if group else "ON true"
    am, ma = (f"{match_arm}, ", f" AND x.{match_arm} IS NOT DISTINCT FROM y.{match_arm}") if match_arm else ("", "")
    return f"""
SELECT {g}c.* {'EXCLUDE (' + group + ')' if group else ''}, {_LCOLS} FROM (
 SELECT {g}count(*) AS scenarios, round(sum(duration_s)/3600.0, 2) AS hours, sum(events)::BIGINT AS truth_events, sum(detected)::BIGINT AS detected_events,
  round(sum(detected)/sum(events), 4) AS recall, sum(alerts)::BIGINT AS alerts_raised, sum(falses)::BIGINT AS false_alerts,
  round((sum(alerts)-sum(falses))/sum(alerts), 4) AS "precision", round(sum(falses)/(sum(duration_s)/3600.0), 2) AS false_alerts_per_hour
 FROM (SELECT x.*, (SELECT count(*) FROM evt e WHERE e.scenario_id=x.scenario_id) AS events,
   (SELECT count(*) FROM evt e JOIN {raised_part} y ON y.scenario_id=e.scenario_id AND y.a=e.a AND y.b=e.b WHERE e.scenario_id=x.scenario_id{ma}
      AND y.raised_us <= {EPOCH}+e.started_s*1000000) AS detected,
   (SELECT count(*) FROM {raised_part} y WHERE y.scenario_id=x.scenario_id{ma}) AS alerts,
   (SELECT count(*) FROM {raised_part} y WHERE y.scenario_id=x.scenario_id{ma} AND NOT EXISTS (SELECT 1 FROM evt e WHERE e.scenario_id=y.scenario_id AND e.a=y.a AND e.b=y.b)) AS falses
  FROM ({arms_from}) x) {gb}) c LEFT JOIN (
 SELECT {g}{_LEADS} FROM (
  SELECT {g}scenario_id, alert_key, arg_max(lead_s, started_s) AS lead_s FROM (
   SELECT {', '.join('x.' + c.strip() for c in group.split(',')) + ',' if group else ''} y.scenario_id, y.alert_key, e.started_s, ({EPOCH}+e.started_s*1000000-y.raised_us)/1000000.0 AS lead_s
   FROM ({arms_from}) x JOIN {raised_part} y ON y.scenario_id=x.scenario_id{ma} JOIN evt e ON e.scenario_id=y.scenario_id AND e.a=y.a AND e.b=y.b
   WHERE y.raised_us <= {EPOCH}+e.started_s*1000000) GROUP BY {g}scenario_id, alert_key) {gb}) l {using}"""


stmt("e05_conflict_scorecard", scorecard("", "SELECT * FROM scn", "raised"), "scn", "raised", "evt")
stmt("k11_conflict_evaluation", scorecard("family", "SELECT * FROM scn", "raised"), "scn", "raised", "evt")
stmt("k15_manoeuvre_density", scorecard("density", "SELECT * FROM scn", "raised"), "scn", "raised", "evt")
_LOOK = "SELECT scn.*, CAST(v.x AS DOUBLE) AS lookahead_s FROM scn CROSS JOIN (VALUES (60.0),(120.0),(180.0),(240.0),(300.0)) v(x)"
stmt("k14_lookahead_sweep", scorecard("family, lookahead_s", _LOOK, "raisedk", "lookahead_s"), "scn", "raisedk", "evt")
stmt("d12_sweep_detections", "SELECT scenario_id, lookahead_s, count(*) AS n, round(min(tc),3) AS soonest FROM rconl GROUP BY ALL", "rconl")
part("rcont", """
SELECT c.*, CAST(v.x AS DOUBLE) AS threshold FROM scr c CROSS JOIN (VALUES (-1.0),(0.01),(0.05),(0.1),(0.2),(0.35),(0.5),(0.7)) v(x)
WHERE CASE WHEN v.x < 0 THEN c.minh < 5.0 AND c.minv < 1000.0 ELSE c.prob >= v.x END""", "scr")
raised("t", "rcont", "threshold")
_THR = "SELECT scn.*, CAST(v.x AS DOUBLE) AS threshold FROM scn CROSS JOIN (VALUES (-1.0),(0.01),(0.05),(0.1),(0.2),(0.35),(0.5),(0.7)) v(x)"
part("armed", f"""
SELECT x.scenario_id, x.threshold, (SELECT count(*) FROM raisedt y WHERE y.scenario_id=x.scenario_id AND y.threshold=x.threshold) AS alerts,
 (SELECT count(*) FROM raisedt y WHERE y.scenario_id=x.scenario_id AND y.threshold=x.threshold AND NOT EXISTS (SELECT 1 FROM evt e WHERE e.scenario_id=y.scenario_id AND e.a=y.a AND e.b=y.b)) AS falses
FROM ({_THR}) x""", "scn", "raisedt", "evt")


def picks(resamples: int, seed: int, ids: str) -> str:
    h = "CAST('0x' || substr(md5('{}'), 1, 8) AS BIGINT)"
    return f"""
SELECT b, n2.scenario_id, count(*) AS times FROM (
 SELECT b, CAST('0x' || substr(md5('{seed}|' || b || '|' || idx), 1, 8) AS BIGINT) % n_all AS idx FROM num CROSS JOIN range({resamples}) r(b)) d
JOIN num n2 ON n2.idx=d.idx GROUP BY ALL"""


def num(ids: str) -> str:
    return f"""
SELECT scenario_id, row_number() OVER (ORDER BY CAST('0x' || substr(md5('0|' || scenario_id), 1, 8) AS BIGINT) % 1024, scenario_id) - 1 AS idx,
 count(*) OVER () AS n_all FROM ({ids})"""


# Scenarios of equal outcomes are one class; a resample splits its draws down a binary tree over the classes.
part("cls", """
SELECT *, row_number() OVER (ORDER BY CAST('0x' || substr(md5('0|' || key), 1, 8) AS BIGINT) % 1024, key) - 1 AS idx FROM (
 SELECT key, min(scenario_id) AS rep, count(*) AS c FROM (
  SELECT scenario_id, string_agg(threshold || ':' || alerts || ':' || falses, ',' ORDER BY threshold) AS key FROM armed GROUP BY scenario_id) GROUP BY key)""", "armed")
part("clst", "SELECT CASE max(idx) WHEN 0 THEN 0 ELSE length(bin(max(idx))) END AS depth, sum(c)::BIGINT AS total FROM cls", "cls")
part("clsn", """
SELECT level, idx >> (depth-level) AS node, sum(c)::BIGINT AS size, sum(c) FILTER ((idx >> (depth-level-1)) % 2 = 0)::BIGINT AS lft
FROM cls CROSS JOIN (SELECT depth, unnest(range(depth)) AS level FROM clst) GROUP BY ALL""", "cls", "clst")
part("clsb", """
SELECT level, node, n, list(cdf ORDER BY j) AS cdfs FROM (
 SELECT level, node, n, j, sum(exp(lgamma(n+1)-lgamma(j+1)-lgamma(n-j+1) + j*ln(lft/size) + (n-j)*ln(1-lft/size))) OVER (PARTITION BY level, node, n ORDER BY j) AS cdf FROM (
  SELECT *, unnest(range(n+1)) AS j FROM (SELECT clsn.*, unnest(range(total+1)) AS n FROM clsn CROSS JOIN clst WHERE lft < size))) GROUP BY ALL""", "clsn", "clst")
part("pk", """
WITH RECURSIVE t AS (
 SELECT b, 0::BIGINT AS level, 0::BIGINT AS node, total AS n FROM range(10000) r(b) CROSS JOIN clst
 UNION ALL
 SELECT b, level+1, 2*node+h, CASE h WHEN 0 THEN k ELSE n-k END FROM (
  SELECT t.*, CASE WHEN clsn.lft=clsn.size THEN t.n ELSE least(t.n, len(list_filter(clsb.cdfs, lambda x:
    x <= (CAST('0x' || substr(md5('20260816|' || t.b || '|' || (t.level+1) || '|' || t.node), 1, 8) AS BIGINT)::DOUBLE + 0.5::DOUBLE)/4294967296::DOUBLE))) END AS k
  FROM t JOIN clsn ON clsn.level=t.level AND clsn.node=t.node LEFT JOIN clsb ON clsb.level=t.level AND clsb.node=t.node AND clsb.n=t.n
  WHERE t.n > 0) CROSS JOIN (VALUES (0),(1)) v(h))
SELECT b, rep AS scenario_id, n AS times FROM t JOIN clst ON level=depth JOIN cls ON idx=node WHERE n > 0""", "clst", "clsn", "clsb", "cls")
part("pdelta", """
SELECT threshold, round(any_value(pd),4) AS precision_delta, round(lo,4) AS ci95_low, round(hi,4) AS ci95_high, lo > 0 OR hi < 0 AS excludes_zero, n AS iterations FROM (
 SELECT threshold, count(*) AS n, list_sort(list(delta))[CAST(floor(count(*)*25/1000) AS BIGINT)+1] AS lo, list_sort(list(delta))[CAST(floor(count(*)*975/1000) AS BIGINT)+1] AS hi FROM (
  SELECT c.threshold, b, round((sum(times*c.alerts)-sum(times*c.falses))/sum(times*c.alerts) - (sum(times*z.alerts)-sum(times*z.falses))/sum(times*z.alerts), 6) AS delta
  FROM armed c JOIN armed z ON z.scenario_id=c.scenario_id AND z.threshold < 0 JOIN pk ON pk.scenario_id=c.scenario_id
  WHERE c.threshold > 0 GROUP BY c.threshold, b) WHERE delta IS NOT NULL AND NOT isnan(delta) GROUP BY threshold) q
JOIN (SELECT c.threshold, (sum(c.alerts)-sum(c.falses))/sum(c.alerts) - (sum(z.alerts)-sum(z.falses))/sum(z.alerts) AS pd
  FROM armed c JOIN armed z ON z.scenario_id=c.scenario_id AND z.threshold < 0 WHERE c.threshold > 0 GROUP BY c.threshold) s USING (threshold)
GROUP BY ALL""", "armed", "pk")
stmt("e12_precision_bootstrap", "SELECT * FROM pdelta", "pdelta")
stmt("k13_detector_comparison", f"""
SELECT CASE WHEN threshold < 0 THEN NULL ELSE threshold END AS threshold, * EXCLUDE (threshold) FROM ({scorecard('threshold', _THR, 'raisedt', 'threshold')}) LEFT JOIN pdelta USING (threshold)""",
     "scn", "raisedt", "evt", "pdelta")
part("app", f"""
SELECT r.scenario_id, r.a, r.b, min({hav('x.lat', 'x.lon', 'y.lat', 'y.lon')}) AS h, arg_min(abs(x.altitude_ft-y.altitude_ft), {hav('x.lat', 'x.lon', 'y.lat', 'y.lon')}) AS v,
 bool_or({hav('x.lat', 'x.lon', 'y.lat', 'y.lon')} < 5.0 AND abs(x.altitude_ft-y.altitude_ft) < 1000.0) AS ever
FROM raised r JOIN tru x ON x.scenario_id=r.scenario_id AND x.icao24=r.a JOIN tru y ON y.scenario_id=r.scenario_id AND y.icao24=r.b AND y.sec=x.sec GROUP BY ALL""", "raised", "tru")
part("fore", """
SELECT r.*, coalesce(h, 'infinity'::DOUBLE) AS th, coalesce(v, 'infinity'::DOUBLE) AS tv, coalesce(ever, false) AS ever, coalesce(h, 'infinity'::DOUBLE) - r.minh AS err
FROM raised r LEFT JOIN app USING (scenario_id, a, b)""", "raised", "app")
stmt("e04_closest_approach", "SELECT scenario_id, a AS first_icao24, b AS second_icao24, round(h,4)+0.0 AS true_min_horizontal_nm, round(v,4)+0.0 AS true_vertical_at_closest_ft, ever AS ever_conflicted FROM app", "app")
stmt("d11_alerts_against_truth", "SELECT scenario_id, alert_key, ever AS ever_conflicted, round(th,3)+0.0 AS true_min_horizontal_nm, round(err,3)+0.0 AS horizontal_error_nm FROM fore", "fore")
stmt("e09_false_alert_profile", """
SELECT ever AS ever_conflicted, measure, n, round(CASE WHEN n % 2 = 1 THEN l[n//2+1] ELSE (l[n//2]+l[n//2+1])/2.0 END,2) AS median,
 round(l[n//10+1],2) AS p10, round(l[least(n-1, 9*n//10)+1],2) AS p90, round(l[1],2) AS min, round(l[n],2) AS max FROM (
 SELECT ever, measure, count(*) AS n, list_sort(list(value)) AS l FROM (
  SELECT ever, 'true_min_horizontal_nm' AS measure, th AS value FROM fore UNION ALL SELECT ever, 'predicted_horizontal_nm', minh FROM fore
  UNION ALL SELECT ever, 'horizontal_error_nm', err FROM fore UNION ALL SELECT ever, 'time_to_cpa_s', tc FROM fore) WHERE isfinite(value) GROUP BY ALL)""", "fore")
stmt("k16_false_alert_forensics", """
SELECT count(*) AS alerts, count(*) FILTER (ever) AS true_alerts, count(*) FILTER (NOT ever) AS false_alerts,
 count(*) FILTER (NOT ever AND th < 10.0) AS within_two_standards, count(*) FILTER (NOT ever AND th < 5.0 AND tv >= 1000.0) AS lateral_only FROM fore""", "fore")
stmt("e19_airspace_hours", "SELECT family, count(*) AS scenarios, round(sum(duration_s)/3600.0,4) AS hours FROM scn GROUP BY ALL", "scn")

# Conformance evaluation.
part("cdet", "SELECT scenario_id, icao24, tick_us, vanish_tick_us, 'non_conformance:' || track_id AS alert_key FROM scanr", "scanr")
part("cisl", islands("cdet"), "cdet")
part("adv", f"SELECT scenario_id, icao24, (tick_us-{EPOCH})/1000000.0 AS at_s FROM cisl WHERE opens", "cisl")
part("att", """
SELECT *, m IS NOT NULL AS attributed FROM (
 SELECT a.*, (SELECT arg_max(struct_pack(at_s := p.at_s, kind := p.kind), (p.at_s, CASE WHEN p.kind='ClimbTo' THEN 1 ELSE 0 END))
   FROM plan p WHERE p.scenario_id=a.scenario_id AND p.icao24=a.icao24 AND p.at_s <= a.at_s AND a.at_s <= p.at_s+240.0) AS m FROM adv a)""", "adv", "plan")
part("cout", """
SELECT p.*, (SELECT min(t.at_s-p.at_s) FROM att t WHERE t.scenario_id=p.scenario_id AND t.icao24=p.icao24 AND t.attributed AND t.m.at_s=p.at_s AND t.m.kind=p.kind) AS lag_s,
 row_number() OVER (PARTITION BY scenario_id, icao24 ORDER BY at_s, kind) = 1 AS is_first FROM plan p""", "plan", "att")
stmt("d09_attributed_advisories", """
SELECT scenario_id, icao24, round(at_s,3)+0.0 AS at_s, attributed, m.at_s AS cause_at_s, m.kind AS cause_kind, round(at_s-m.at_s,3)+0.0 AS lag_s FROM att""", "att")
_REC = "count(*) AS manoeuvres, count(lag_s) AS detected, round(count(lag_s)/count(*),4) AS recall"
stmt("e07_recall_by_kind", f"SELECT kind, {_REC} FROM cout GROUP BY ALL", "cout")
stmt("e08_recall_first_or_later", f"SELECT is_first, {_REC} FROM cout GROUP BY ALL", "cout")
stmt("f10_manoeuvre_ordinal", "SELECT scenario_id, kind, is_first, count(*) AS n, count(lag_s) AS detected FROM cout GROUP BY ALL", "cout")
stmt("k12_conformance_evaluation", f"SELECT family, kind, {_REC} FROM cout JOIN scn USING (scenario_id) GROUP BY ALL", "cout", "scn")
stmt("e06_conformance_scorecard", """
SELECT (SELECT count(*) FROM scn) AS scenarios, (SELECT round(sum(duration_s)/3600.0,2) FROM scn) AS hours, count(*) AS manoeuvres, count(lag_s) AS detected_manoeuvres,
 round(count(lag_s)/count(*),4) AS recall, round(count(lag_s) FILTER (is_first)/count(*) FILTER (is_first),4) AS recall_first,
 round(count(lag_s) FILTER (NOT is_first)/count(*) FILTER (NOT is_first),4) AS recall_later,
 (SELECT count(*) FROM att) AS advisories, (SELECT count(*) FILTER (NOT attributed) FROM att) AS unattributed,
 (SELECT round(count(*) FILTER (attributed)/count(*),4) FROM att) AS "precision",
 (SELECT round(count(*) FILTER (NOT attributed)/(SELECT sum(duration_s)/3600.0 FROM scn),2) FROM att) AS unattributed_per_hour,
 count(lag_s) AS lag_count, round(median(lag_s),1) AS lag_median_s,
 CASE WHEN count(lag_s) >= 10 THEN round(list_sort(list(lag_s) FILTER (lag_s IS NOT NULL))[count(lag_s)//10+1],1) END AS lag_p10_s,
 CASE WHEN count(lag_s) >= 10 THEN round(list_sort(list(lag_s) FILTER (lag_s IS NOT NULL))[9*count(lag_s)//10+1],1) END AS lag_p90_s,
 round(max(lag_s),1) AS lag_max_s FROM cout""", "cout", "att", "scn")
