"""SQL for the queries over records, scalar functions, read models, telemetry and data sets."""

from __future__ import annotations

import re

from oracle.parts import DEPS, EPOCH, PARTS, R, bdiff, bearing, dest_lat, dest_lon, enu_e, enu_n, hav, part, pmod, statement, un_lat, un_lon, wrap180
from oracle.statements import _REC, END, erf, picks, picture, num, rnd, stmt

AS_OF = EPOCH + 200000000
A, O = "40.6", "-100.0"


def rep(name: str, digits: int, **cols: str) -> None:
    stmt(name, "SELECT report_id, " + ", ".join(f"round({v}, {digits})+0.0 AS {k}" for k, v in cols.items()) + " FROM rep", "rep")


rep("b01_units", 8, nm_s="ground_speed_kt/3600.0", ft_s="vertical_rate_fpm/60.0")
rep("b02_normalize_bearing", 6, bearing=pmod("track_deg-540.5"))
rep("b03_bearing_difference", 6, turn=bdiff("track_deg", "90.0"))
rep("b04_haversine", 5, nm=hav(A, O, "lat", "lon"))
rep("b05_initial_bearing", 6, deg=bearing(A, O, "lat", "lon"))
rep("b06_destination_point", 7, lat=dest_lat("lat", "track_deg", "37.5"), lon=dest_lon("lat", "lon", "track_deg", "37.5"))
rep("b07_to_local_enu", 6, east=enu_e("round_even(lat,0)", "round_even(lon,0)", "lat", "lon"), north=enu_n("round_even(lat,0)", "lat"))
rep("b08_from_local_enu", 7, lat=un_lat(A, "lon*0.5"), lon=un_lon(A, O, "lat*2.0", "lon*0.5"))
_D = "ground_speed_kt/3600.0*60.0"
rep("b09_project_forward", 7, lat=dest_lat("lat", "track_deg", _D), lon=dest_lon("lat", "lon", "track_deg", _D))
stmt("b10_dead_reckoned_altitude", """
SELECT report_id, CASE WHEN altitude_baro_ft+vertical_rate_fpm IS NOT NULL THEN round(greatest(0.0, altitude_baro_ft+vertical_rate_fpm/60.0*60.0),4)+0.0 END AS ft,
 altitude_baro_ft AS persistence_ft FROM rep""", "rep")
_P3 = "scenario_id, icao24, t_us"
_leg = "ground_speed_kt/3600.0*5.0"
_mid = pmod("hdg + turn_rate_deg_s*5.0/2.0")
part("legs", f"""
SELECT *, lat AS la, lon AS lo, track_deg AS hdg, 0 AS step FROM upd
UNION ALL
SELECT * REPLACE ({dest_lat('la', _mid, _leg)} AS la, {dest_lon('la', 'lo', _mid, _leg)} AS lo, {pmod('hdg + turn_rate_deg_s*5.0')} AS hdg, step+1 AS step) FROM legs WHERE step < 12""", "upd")
stmt("b11_constant_turn", f"""
SELECT {_P3}, round(CASE WHEN abs(turn_rate_deg_s) < 1e-6 THEN {dest_lat('lat', 'track_deg', _D)} ELSE la END, 6)+0.0 AS lat,
 round(CASE WHEN abs(turn_rate_deg_s) < 1e-6 THEN {dest_lon('lat', 'lon', 'track_deg', _D)} ELSE lo END, 6)+0.0 AS lon FROM legs WHERE step = 12""", "legs")
_w, _v = "radians(turn_rate_deg_s)", "(ground_speed_kt/3600.0)"
_arc_a = f"CASE WHEN abs({_w}) > 1e-9 THEN {_v}/nullif({_w},0)*sin({_w}*60.0)-{_v}*60.0 ELSE 0.0 END"
_arc_c = f"CASE WHEN abs({_w}) > 1e-9 THEN {_v}/nullif({_w},0)*(1.0-cos({_w}*60.0)) ELSE 0.0 END"
stmt("b12_physics_residuals", f"SELECT {_P3}, round({_arc_a},5)+0.0 AS turn_along, round({_arc_c},5)+0.0 AS turn_cross, round(-{_v}*60.0,5)+0.0 AS stay_along, round(-vertical_rate_fpm/60.0*60.0,5)+0.0 AS stay_alt FROM upd", "upd")
_dist, _rel = hav("lat", "lon", "lat+0.05", "lon+0.05"), f"radians({bearing('lat', 'lon', 'lat+0.05', 'lon+0.05')}-track_deg)"
stmt("b13_along_cross", f"SELECT report_id, round({_dist}*cos({_rel}),5)+0.0 AS along, round({_dist}*sin({_rel}),5)+0.0 AS \"cross\", CASE WHEN track_deg IS NOT NULL THEN round(lat+0.05,6)+0.0 END AS lat, CASE WHEN track_deg IS NOT NULL THEN round(lon+0.05,6)+0.0 END AS lon FROM rep", "rep")
stmt("b14_snapped_origin", "SELECT report_id, round_even(lat,0) AS lat, round_even(lon,0) AS lon FROM rep", "rep")
stmt("b15_track_id", "SELECT report_id, 'trk-' || icao24 AS track_id FROM rep", "rep")
stmt("b16_projected_sigma", f"SELECT {_P3}, round(sqrt(power(altitude_uncertainty_ft,2)+625.0+(power(vertical_rate_uncertainty_fpm/60.0,2)+1.0)*14400.0),4)+0.0 AS sigma_ft FROM upd", "upd")
part("pin", f"SELECT {_P3}, ground_speed_kt/100.0 AS miss, position_uncertainty_m/100.0 AS sigma, altitude_ft-31000.0 AS off, altitude_uncertainty_ft*20.0 AS sv, row_number() OVER () AS id FROM upd", "upd")
part("pband", f"SELECT *, greatest(0.0, 0.5*({erf('((1000.0-off)/sv/sqrt(2.0))')} - {erf('((-1000.0-off)/sv/sqrt(2.0))')})) AS pb, miss/sigma AS ua, 5.0/sigma AS ub FROM pin", "pin")
part("prace", """
SELECT id, sum(exp(CASE WHEN ma > 0 THEN j*ln(ma)-ma-lgamma(j+1) WHEN j = 0 THEN 0.0 ELSE -1e9 END) * surv) AS disc FROM (
 SELECT id, j, ma, coalesce(sum(exp(j*ln(mb)-mb-lgamma(j+1))) OVER (PARTITION BY id ORDER BY j DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS surv
 FROM (SELECT id, 0.5*ua*ua AS ma, 0.5*ub*ub AS mb, unnest(generate_series(0, CAST(ceil(greatest(0.5*ua*ua,0.5*ub*ub)+14*sqrt(greatest(0.5*ua*ua,0.5*ub*ub)+1))+10 AS BIGINT))) AS j
   FROM pband WHERE abs(ua-ub) <= 9.0)) GROUP BY id""", "pband")
part("pdisc", "SELECT b.*, CASE WHEN ua-ub > 9.0 THEN 0.0 WHEN ub-ua > 9.0 THEN 1.0 ELSE disc END AS pd FROM pband b LEFT JOIN prace USING (id)", "pband", "prace")
stmt("b17_band_probability", f"SELECT {_P3}, round(pb,6)+0.0 AS p FROM pband", "pband")
stmt("b18_disc_probability", f"SELECT {_P3}, round(pd,6)+0.0 AS p FROM pdisc", "pdisc")
stmt("b19_conflict_probability", f"SELECT {_P3}, round(pd*pb,6)+0.0 AS p FROM pdisc", "pdisc")
stmt("b20_flight_phase", "SELECT scenario_id, icao24, sec, phase FROM tru", "tru")

# -- records ----------------------------------------------------------------

stmt("a01_json_reports", "SELECT report_id, icao24, callsign, t_us, lat, lon, altitude_baro_ft, ground_speed_kt, track_deg, squawk, on_ground, scenario_id FROM rep", "rep")
stmt("a02_dead_letters", """
SELECT CASE WHEN value < 5.0 THEN 'malformed_json' WHEN value > 25.0 AND value < 26.0 THEN 'bad_timestamp' WHEN value >= 100.0 AND event_type='click' THEN 'unknown_field'
 WHEN value >= 100.0 AND event_type='view' THEN 'lat_range' WHEN value >= 100.0 AND event_type='error' THEN 'icao24_pattern'
 WHEN value >= 100.0 AND event_type='signup' THEN 'squawk_pattern' WHEN value >= 100.0 AND value < 150.0 AND event_type='purchase' THEN 'missing_report_id'
 ELSE 'valid' END AS outcome, count(*) AS n FROM events GROUP BY ALL""")
stmt("a02_track_dead_letters", """
SELECT CASE update_count % 10 WHEN 1 THEN 'innovation_nm_range' WHEN 2 THEN 'velocity_uncertainty_kt_range' WHEN 3 THEN 'altitude_uncertainty_ft_range'
 WHEN 5 THEN 'state_value' WHEN 6 THEN 'update_count_range' ELSE 'valid' END AS outcome, count(*) AS n FROM trk WHERE state IN ('initiating', 'confirmed') GROUP BY ALL""", "trk")
stmt("a03_keyed_messages", """
SELECT icao24 AS key, format('{{"icao24":"{}","report_id":"{}","lat":{},"lon":{}}}', icao24, report_id, CAST(lat AS VARCHAR), CAST(lon AS VARCHAR)) AS value FROM rep""", "rep")
stmt("a04_correlation_ids", """
SELECT CAST(user_id % 6 AS INT) AS partition, event_id AS "offset", CASE WHEN event_type='view' THEN json_extract_string(props, '$.k')
 ELSE substr(sha256('surveillance.reports.v1|' || (user_id % 6) || '|' || event_id), 1, 32) END AS correlation_id FROM events""")
stmt("a05_start_positions", "SELECT CAST(user_id % 6 AS INT) AS partition, min(event_id) AS earliest, max(event_id)+1 AS latest, count(*) AS messages FROM events GROUP BY ALL")
stmt("a06_idempotent_points", f"SELECT scenario_id, track_id, t_us, {rnd(6, 'lat', 'lon', 'altitude_ft')} FROM trk WHERE t_us > {AS_OF}", "trk")


def newest(src: str, cond: str) -> str:
    return f"""SELECT * FROM {src} WHERE {cond} QUALIFY row_number() OVER (PARTITION BY scenario_id, track_id ORDER BY t_us DESC, last_report_us DESC) = 1"""


stmt("a07_upserted_tracks", f"""
SELECT coalesce(o.scenario_id, n.scenario_id) AS scenario_id, coalesce(o.track_id, n.track_id) AS track_id, coalesce(o.icao24, n.icao24) AS icao24,
 CASE WHEN n.t_us IS NOT NULL THEN n.callsign ELSE o.callsign END AS callsign, coalesce(o.fs, n.fs) AS first_seen_us,
 coalesce(n.t_us, o.t_us) AS last_seen_us, coalesce(n.state, o.state) AS state, coalesce(n.update_count, o.update_count) AS update_count
FROM (SELECT * FROM ({newest('trk', f't_us <= {AS_OF}')}) JOIN (SELECT scenario_id, track_id, min(last_report_us) AS fs FROM trk WHERE t_us <= {AS_OF} GROUP BY ALL) USING (scenario_id, track_id)) o
FULL JOIN (SELECT * FROM ({newest('trk', f't_us > {AS_OF - 30000000}')}) JOIN (SELECT scenario_id, track_id, min(last_report_us) AS fs FROM trk WHERE t_us > {AS_OF - 30000000} GROUP BY ALL) USING (scenario_id, track_id)) n
 ON o.scenario_id=n.scenario_id AND o.track_id=n.track_id""", "trk")
part("known", newest("trk", f"t_us <= {AS_OF}"), "trk")


def live(window: int) -> str:
    return f"(SELECT * FROM known WHERE state <> 'terminated' AND t_us >= {AS_OF - window * 1000000})"


stmt("a08_live_picture", f"SELECT scenario_id, track_id, t_us, state, {rnd(6, 'lat', 'lon')} FROM {live(20)}", "known")
stmt("a11_live_tracks_window", f"SELECT scenario_id, track_id, callsign, t_us, state FROM {live(60)}", "known")
stmt("g04_tracks_by_label", f"SELECT scenario_id, track_id, coalesce(callsign, icao24) AS label FROM {live(10)}", "known")
part("actv", f"""
SELECT * FROM (SELECT * FROM life WHERE updated_us <= {AS_OF} QUALIFY row_number() OVER (PARTITION BY scenario_id, alert_key
 ORDER BY updated_us DESC, CASE st WHEN 'new' THEN 0 WHEN 'sustained' THEN 1 ELSE 2 END DESC) = 1) WHERE st <> 'cleared' AND updated_us >= {AS_OF - 300000000}""", "life")
stmt("a09_active_alerts", "SELECT scenario_id, alert_key, kind, severity, st AS state, updated_us FROM actv", "actv")
stmt("a12_alerts_of_kind", "SELECT scenario_id, alert_key, kind, updated_us FROM actv WHERE kind IN ('emergency_squawk','non_conformance')", "actv")
stmt("g02_alerts_by_severity", "SELECT scenario_id, alert_key, severity, updated_us FROM actv", "actv")
stmt("g03_alerts_newest_first", "SELECT scenario_id, alert_key, updated_us FROM actv", "actv")
stmt("d15_alerted_tracks", f"""
SELECT t.scenario_id, t.track_id, EXISTS (SELECT 1 FROM actv a WHERE a.scenario_id=t.scenario_id AND list_contains(string_split(a.track_ids, ','), t.track_id)) AS alerted FROM {live(20)} t""", "known", "actv")
stmt("a10_history_tail", "SELECT scenario_id, track_id, t_us, round(altitude_ft,5)+0.0 AS altitude_ft, CAST(r AS INT) AS age_rank FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id, track_id ORDER BY t_us DESC) AS r FROM trk) WHERE r <= 50", "trk")
stmt("g05_top_points_per_track", "SELECT scenario_id, track_id, t_us, state, CAST(r AS INT) AS age_rank FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id, track_id ORDER BY t_us DESC) AS r FROM trk) WHERE r <= 3", "trk")
stmt("f07_track_trails", """
SELECT scenario_id, track_id, CAST(count(*) AS INT) AS points, string_agg(CAST(round(lat,4) AS VARCHAR) || '@' || t_us, ';' ORDER BY t_us) AS trail
FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id, track_id ORDER BY t_us DESC) AS r FROM trk WHERE state <> 'terminated') WHERE r <= 90 GROUP BY scenario_id, track_id""", "trk")


def dealt(src: str, ident: str) -> str:
    """Rows with their part: forty a part, by a hash of the id."""
    return f"""(SELECT *, CAST(CAST('0x' || substr(md5('5|' || {ident}), 1, 8) AS BIGINT) % CAST(ceil(count(*) OVER (PARTITION BY scenario_id)/40.0) AS BIGINT) AS INT) AS part FROM {src})"""


stmt("a13_snapshot_frames", f"""
SELECT coalesce(t.scenario_id, a.scenario_id) AS scenario_id, coalesce(t.part, a.part) AS part, coalesce(tracks, '') AS tracks, coalesce(alerts, '') AS alerts
FROM (SELECT scenario_id, part, string_agg(coalesce(callsign, icao24), ',' ORDER BY coalesce(callsign, icao24)) AS tracks FROM {dealt(live(20), 'track_id')} GROUP BY ALL) t
FULL JOIN (SELECT scenario_id, part, string_agg(alert_key, ',' ORDER BY alert_key) AS alerts FROM {dealt('actv', 'alert_key')} GROUP BY ALL) a ON a.scenario_id=t.scenario_id AND a.part=t.part""", "known", "actv")
stmt("a02_alert_dead_letters", """
SELECT kind, CASE d WHEN '0' THEN 'conflict.lookahead_s_range' WHEN '1' THEN 'conflict.min_vertical_sep_ft_range' WHEN '2' THEN 'conflict.missing_min_vertical_sep_ft'
 WHEN '3' THEN 'severity_value' ELSE 'missing_summary' END AS reasons, count(*) AS n
FROM (SELECT kind, substr(sha256(scenario_id || '|' || alert_key || '|' || CAST(raised_us AS VARCHAR)), 1, 1) AS d FROM life)
WHERE d IN ('3', '4') OR (kind='predicted_conflict' AND d IN ('0', '1', '2')) GROUP BY ALL""", "life")
stmt("a14_flight_plans", "SELECT scenario_id, icao24, at_s, kind FROM plan", "plan")
part("spec", f"SELECT scenario_id, icao24, substr('AC' || lpad(CAST(user_id AS VARCHAR),6,'0'),1,7) AS callsign, (first_us-{EPOCH})/1000000.0 AS entry_s FROM act", "act")
stmt("a15_scenario_violations", """
SELECT scenario_id, 'duplicate_callsign' AS violation, callsign AS value FROM spec GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT scenario_id, 'duplicate_icao24', icao24 FROM spec GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT scenario_id, 'enters_after_end', callsign FROM spec WHERE entry_s >= 5.0""", "spec")
_lane = ", ".join(f"sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS l{i}" for i in range(8))
stmt("a16_fingerprint", f"""
SELECT n AS "rows", substr(sha256({" || ':' || ".join(['CAST(n AS VARCHAR)'] + [f'CAST(l{i} AS VARCHAR)' for i in range(8)])}), 1, 16) AS fingerprint
FROM (SELECT count(*) AS n, {_lane} FROM (SELECT sha256(concat_ws('|', scenario_id, icao24, sec, CAST(lat AS VARCHAR), CAST(lon AS VARCHAR), CAST(altitude_ft AS VARCHAR), phase)) AS h FROM tru))""", "tru")
stmt("h04_scenario_union", "SELECT scenario_id, family, 'generated' AS origin FROM scn WHERE family='nominal' UNION ALL SELECT scenario_id, family, 'curated' FROM scn WHERE density > 0.3", "scn")
_F = ["callsign", "altitude_baro_ft", "ground_speed_kt", "track_deg", "vertical_rate_fpm", "squawk"]
_fields = " UNION ALL ".join(f"SELECT '{f}' AS field, event_type, count({f}) AS c, count(*) AS n FROM j GROUP BY event_type" for f in _F)
part("j", "SELECT r.*, e.event_type FROM rep r JOIN ev e ON r.report_id = e.scenario_id || '-' || lpad(CAST(e.event_id AS VARCHAR), 9, '0')", "rep", "ev")
stmt("h05_schema_drift", f"""
SELECT field, CASE WHEN nc = 0 THEN 'removed' ELSE 'newly_required' END AS change FROM (
 SELECT field, max(c) FILTER (event_type='view') AS oc, max(n) FILTER (event_type='view') AS onn, max(c) FILTER (event_type='signup') AS nc, max(n) FILTER (event_type='signup') AS nn
 FROM ({_fields}) GROUP BY field) WHERE (oc > 0 AND nc = 0) OR (nc > 0 AND nc = nn AND (oc = 0 OR oc < onn))""", "j")

# -- filters, telemetry, clocks ---------------------------------------------

stmt("c05_confirmed_only", "SELECT scenario_id, count(*) AS n FROM upd WHERE state='confirmed' GROUP BY ALL", "upd")
stmt("c07_clock_guard", f"SELECT scenario_id, count(*) FILTER (t_us <= {EPOCH + 130000000}) AS on_time, count(*) FILTER (t_us > {EPOCH + 130000000}) AS ahead FROM rep GROUP BY ALL", "rep")
stmt("e16_counters", "SELECT updated_us//60000000*60000000 AS window_us, kind, st AS state, count(*) AS n FROM life GROUP BY ALL", "life")
stmt("e16_live_tracks", """
SELECT scenario_id, m*60000000 AS at_us, (SELECT count(*) FROM pic p WHERE p.scenario_id=g.scenario_id AND p.tick_us=m*60000000) AS n FROM (
 SELECT scenario_id, unnest(generate_series((min(tick_us)+59999999)//60000000, (max(tick_us)+1000000+59999999)//60000000)) AS m FROM pic GROUP BY scenario_id) g""", "pic")
part("spell", f"SELECT scenario_id, kind, raised_us AS s, max(clear_us) FILTER (clear_us <= {END}) AS e FROM isl GROUP BY scenario_id, kind, alert_key, raised_us", "isl")
stmt("e16_active_alerts", """
SELECT scenario_id, kind, m*60000000 AS at_us, (SELECT count(*) FROM spell p WHERE p.scenario_id=g.scenario_id AND p.kind=g.kind AND p.s <= m*60000000 AND (p.e IS NULL OR p.e > m*60000000)) AS n FROM (
 SELECT scenario_id, kind, unnest(generate_series((min(s)+59999999)//60000000, (max(greatest(s, coalesce(e, s)))+59999999)//60000000)) AS m FROM spell GROUP BY scenario_id, kind) g""", "spell")
stmt("e16_message_counters", """
SELECT 'surveillance.reports.v1' AS topic, CAST(user_id % 6 AS INT) AS partition, count(*) AS n,
 CASE WHEN value < 5.0 OR (value > 25.0 AND value < 26.0) OR (value >= 100.0 AND event_type <> 'purchase') OR (value >= 100.0 AND value < 150.0) THEN 'discarded' ELSE 'consumed' END AS outcome
FROM events GROUP BY ALL""")
stmt("e20_alert_totals", "SELECT kind, st AS state, count(*) AS n FROM life GROUP BY ALL", "life")
stmt("a17_published_results", """
SELECT run, scenario_id, count(*) AS reports, 'wakeline-contracts-v1' AS code_version FROM rep CROSS JOIN (VALUES ('first'), ('second')) r(run) GROUP BY ALL""", "rep")
_EDGES = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
part("latency", "SELECT scenario_id, ((t_us+999999)//1000000*1000000-t_us)/1000000.0 AS x FROM trk WHERE state <> 'terminated'", "trk")
part("ladder", f"""
SELECT scenario_id, e.le, e.low, count(*) FILTER (x <= e.le) AS cum, count(*) FILTER (x <= e.low AND e.low > 0) AS below, count(*) AS total
FROM latency CROSS JOIN (VALUES {', '.join(f'({b}::DOUBLE, {a}::DOUBLE)' for a, b in zip([0.0] + _EDGES, _EDGES))}) e(le, low) GROUP BY ALL""", "latency")
stmt("e17_rates_and_latency", """
SELECT scenario_id, q::DOUBLE AS q, round(coalesce(max(CASE WHEN below < q*total AND cum >= q*total THEN low+(le-low)*(q*total-below)/(cum-below) END), max(le)),6)+0.0 AS value
FROM ladder CROSS JOIN (VALUES (0.5),(0.95),(0.99)) v(q) GROUP BY scenario_id, q""", "ladder")
stmt("e17_report_rates", "SELECT t_us//60000000*60000000 AS window_us, scenario_id, count(*) AS n, round(count(*)/60.0,6)+0.0 AS per_second FROM rep GROUP BY ALL", "rep")
stmt("e18_consumer_lag", f"""
SELECT CAST(p AS INT) AS partition, greatest(0, head-(o+1)) AS lag FROM (SELECT user_id % 6 AS p, max(event_id)+1 AS head, max(event_id) FILTER (t_us <= {AS_OF}) AS o FROM ev GROUP BY ALL) WHERE o IS NOT NULL""", "ev")
stmt("e20_run_totals", """
SELECT 'reports' AS name, count(*) AS n FROM rep UNION ALL SELECT 'updates', count(*) FROM trk UNION ALL SELECT 'terminated', count(*) FROM trk WHERE state='terminated'
UNION ALL SELECT 'scans', count(*) FROM (SELECT DISTINCT scenario_id, tick_us FROM pic) UNION ALL SELECT 'conflicts', count(*) FROM con""", "rep", "trk", "pic", "con")
_GONE = f"(SELECT coalesce(max(t_us) FILTER (state='terminated'), {END}) FROM trk)"
stmt("j05_prunable_tracks", f"SELECT scenario_id, track_id, last_report_us FROM ({newest('trk', f't_us <= {_GONE}')}) WHERE state='terminated' AND last_report_us < {_GONE} - 20000000", "trk")
stmt("j07_scan_summary", "SELECT scenario_id, tick_us, count(*) AS tracks, (SELECT count(*) FROM con c WHERE c.scenario_id=pic.scenario_id AND c.tick_us=pic.tick_us) AS conflicts FROM pic GROUP BY scenario_id, tick_us", "pic", "con")
stmt("j08_predict_and_check", """
SELECT scenario_id, track_id, count(*) AS predictions, (SELECT count(*) FROM chkl c WHERE c.scenario_id=t.scenario_id AND c.track_id=t.track_id) AS checked
FROM trk t WHERE state <> 'terminated' GROUP BY scenario_id, track_id""", "trk", "chkl")
stmt("j06_streamed_scan", "SELECT scenario_id, tick_us, first_track_id, second_track_id FROM con WHERE tick_us <= (SELECT (max(t_us)-2000000)//1000000*1000000 FROM trk)", "con", "trk")
stmt("j08_streamed_checks", "SELECT scenario_id, track_id, predicted_us, matched_us, round(error_nm,4)+0.0 AS error_nm, round(error_nm,4)+0.0 AS baseline_error_nm FROM chkl", "chkl")
# The source is silent after AS_OF; beats follow for 30 s, and a tick closes two seconds after it.
part("pici", picture(f"(SELECT * FROM trk WHERE t_us <= {AS_OF})", f"({AS_OF}+28000000)"), "trk")
stmt("j10_idle_source", "SELECT scenario_id, tick_us, count(*) AS tracks, max(t_us) AS newest_us FROM pici GROUP BY ALL", "pici")
stmt("j10_scan_clock", "SELECT tick_us, max(t_us) AS newest_us, count(*) AS tracks FROM pic GROUP BY ALL", "pic")

# -- data sets --------------------------------------------------------------

_NAMES = ["ground_speed_kt", "vertical_rate_fpm", "turn_rate_deg_s", "altitude_kft", "position_uncertainty_m", "innovation_nm", "speed_change_kt",
          "heading_change_deg", "altitude_change_ft", "turn_rate_mean", "turn_rate_std", "turn_rate_abs_max", "vertical_rate_mean", "vertical_rate_std",
          "innovation_mean", "innovation_max", "is_climbing", "is_descending", "is_turning", "is_high_altitude"]


def feats(src: str) -> str:
    v = ["ground_speed_kt", "vertical_rate_fpm", "turn_rate_deg_s", "altitude_ft/1000.0", "position_uncertainty_m", "coalesce(innovation_nm,0.0)",
         "ground_speed_kt-first_value(ground_speed_kt) OVER w", bdiff("first_value(track_deg) OVER w", "track_deg"), "altitude_ft-first_value(altitude_ft) OVER w",
         "avg(turn_rate_deg_s) OVER w", "stddev_pop(turn_rate_deg_s) OVER w", "max(abs(turn_rate_deg_s)) OVER w", "avg(vertical_rate_fpm) OVER w", "stddev_pop(vertical_rate_fpm) OVER w",
         "avg(coalesce(innovation_nm,0.0)) OVER w", "max(coalesce(innovation_nm,0.0)) OVER w", "CAST(vertical_rate_fpm > 300.0 AS DOUBLE)", "CAST(vertical_rate_fpm < -300.0 AS DOUBLE)",
         "CAST(abs(turn_rate_deg_s) > 0.15 AS DOUBLE)", "CAST(altitude_ft > 29000.0 AS DOUBLE)"]
    cols = ", ".join(f"{x} AS f_{n}" for x, n in zip(v, _NAMES))
    return f"""
SELECT *, {cols}, count(*) OVER w = 20 AND sum(CASE WHEN gone < t_us THEN 1 ELSE 0 END) OVER v = 0 AS whole
FROM (SELECT *, ((lag(t_us) OVER (PARTITION BY scenario_id, track_id ORDER BY t_us)+15000000)//1000000+1)*1000000 AS gone FROM {src})
WINDOW w AS (PARTITION BY scenario_id, track_id ORDER BY t_us ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
 v AS (PARTITION BY scenario_id, track_id ORDER BY t_us ROWS BETWEEN 18 PRECEDING AND CURRENT ROW)"""


_FC = [f"f_{n}" for n in _NAMES]
part("conf", "SELECT * FROM upd WHERE state='confirmed'", "upd")
part("fea", feats("upd"), "upd")
part("feac", feats("conf"), "conf")
stmt("f01_window_features", f"SELECT scenario_id, track_id, t_us, {rnd(4, *_FC)} FROM fea WHERE whole", "fea")
part("flong", " UNION ALL ".join(f"SELECT '{n}' AS feature, f_{n} AS v FROM fea WHERE whole" for n in _NAMES), "fea")
stmt("c08_feature_sanity", "SELECT feature, count(*) AS \"rows\", count(*) FILTER (NOT isfinite(v)) AS non_finite FROM flong GROUP BY ALL", "flong")
stmt("e13_standardiser", "SELECT feature, round(avg(v),5)+0.0 AS mean, round(CASE WHEN stddev_pop(v) < 1e-9 THEN 1.0 ELSE stddev_pop(v) END,5)+0.0 AS scale FROM flong GROUP BY feature", "flong")
stmt("e14_feature_profile", "SELECT feature, round(avg(v),4)+0.0 AS mean, round(stddev_pop(v),4)+0.0 AS std, round(min(v),4)+0.0 AS min, round(max(v),4)+0.0 AS max FROM flong GROUP BY feature", "flong")


def labelled(h: float) -> str:
    d = f"f.ground_speed_kt/3600.0*{h}"
    base = f"{dest_lat('f.lat', 'f.track_deg', d)} AS bla, {dest_lon('f.lat', 'f.lon', 'f.track_deg', d)} AS blo"
    di = hav("bla", "blo", "ala", "alo")
    rel = f"radians({bearing('bla', 'blo', 'ala', 'alo')}-track_deg)"
    return f"""
SELECT *, {di}*cos({rel}) AS y_along, {di}*sin({rel}) AS y_cross, aalt-greatest(0.0, altitude_ft+vertical_rate_fpm/60.0*{h}) AS y_alt, {di} AS base_nm, {h}::DOUBLE AS horizon_s FROM (
 SELECT f.*, n.phase, a.lat AS ala, a.lon AS alo, a.altitude_ft AS aalt, {base}
 FROM (SELECT *, CAST(round_even((t_us-{EPOCH})/1000000.0, 0) AS INT) AS sec FROM feac WHERE whole) f
 JOIN tru n ON n.scenario_id=f.scenario_id AND n.icao24=f.icao24 AND n.sec=f.sec
 JOIN tru a ON a.scenario_id=f.scenario_id AND a.icao24=f.icao24 AND a.sec=f.sec+{int(h)})"""


for _h in (30.0, 60.0, 120.0):
    part(f"ds{int(_h)}", labelled(_h), "feac", "tru")
stmt("d10_residual_labels", f"SELECT scenario_id, track_id, t_us, phase, {rnd(4, 'y_along', 'y_cross', 'y_alt')}, round(base_nm,4)+0.0 AS baseline_error_nm FROM ds60", "ds60")
stmt("k01_dataset", " UNION ALL ".join(f"SELECT horizon_s, phase, count(*) AS samples, count(DISTINCT scenario_id) AS scenarios, round(avg(base_nm),4) AS mean_nm FROM ds{h} GROUP BY horizon_s, phase" for h in (30, 60, 120)), "ds30", "ds60", "ds120")
stmt("k02_splits", """
SELECT scenario_id, CASE WHEN family='shifted' THEN 'test_shifted' WHEN u < 0.6 THEN 'train' WHEN u < 0.75 THEN 'validation' ELSE 'test_same_family' END AS split
FROM (SELECT *, CAST('0x' || substr(md5('7|' || scenario_id), 1, 8) AS BIGINT)/4294967296.0 AS u FROM scn)""", "scn")
part("numnom", num("SELECT scenario_id FROM scn WHERE family='nominal'"), "scn")
stmt("k02_exact_splits", """
SELECT scenario_id, CASE WHEN idx < n_all*60//100 THEN 'train' WHEN idx < n_all*60//100 + greatest(n_all*15//100, 1) THEN 'validation' ELSE 'test_same_family' END AS split FROM numnom
UNION ALL SELECT scenario_id, 'test_shifted' FROM scn WHERE family='shifted'""", "numnom", "scn")
stmt("d13_split_leaks", """
SELECT scenario_id, count(DISTINCT CAST('0x' || substr(md5('3|' || icao24), 1, 8) AS BIGINT)/4294967296.0 < 0.9) AS splits FROM act GROUP BY scenario_id
HAVING count(DISTINCT CAST('0x' || substr(md5('3|' || icao24), 1, 8) AS BIGINT)/4294967296.0 < 0.9) > 1""", "act")
_w2, _v2 = "radians(f_turn_rate_deg_s)", "(f_ground_speed_kt/3600.0)"
_ra = f"CASE WHEN abs({_w2}) > 1e-9 THEN {_v2}/nullif({_w2},0)*sin({_w2}*60.0)-{_v2}*60.0 ELSE 0.0 END"
_rc = f"CASE WHEN abs({_w2}) > 1e-9 THEN {_v2}/nullif({_w2},0)*(1.0-cos({_w2}*60.0)) ELSE 0.0 END"
def physics(h: float) -> str:
    """Scores of the three physics models at a horizon."""
    ra, rc = _ra.replace("*60.0", f"*{h}"), _rc.replace("*60.0", f"*{h}")
    ds = f"ds{int(h)}"
    return f"""
SELECT 'dead_reckoning' AS model, scenario_id, horizon_s, phase, base_nm, sqrt(y_along*y_along+y_cross*y_cross) AS e, abs(y_alt) AS ae FROM {ds}
UNION ALL SELECT 'persistence', scenario_id, horizon_s, phase, base_nm, sqrt(power(y_along+{_v2}*{h},2)+y_cross*y_cross), abs(y_alt+f_vertical_rate_fpm/60.0*{h}) FROM {ds}
UNION ALL SELECT 'constant_turn', scenario_id, horizon_s, phase, base_nm, sqrt(power(y_along-({ra}),2)+power(y_cross-({rc}),2)), abs(y_alt) FROM {ds}"""


part("scored", " UNION ALL ".join(physics(h) for h in (30.0, 60.0, 120.0)), "ds30", "ds60", "ds120")
part("strat", """
SELECT *, 'all' AS stratum FROM scored UNION ALL
SELECT *, CASE phase WHEN 'cruise' THEN 'cruise' WHEN 'turn' THEN 'turning' ELSE 'climbing_or_descending' END FROM scored""", "scored")
stmt("e10_scores_by_stratum", """
SELECT horizon_s, model, stratum, round(median(e),4) AS median_nm, round(quantile_cont(e, 0.9),4) AS p90_nm, round(avg(e),4) AS mean_nm, round(median(ae),1) AS median_altitude_ft,
 round(CASE WHEN median(base_nm) > 0 THEN (median(base_nm)-median(e))/median(base_nm) ELSE 0.0 END,4) AS skill, count(*) AS samples FROM strat GROUP BY horizon_s, model, stratum""", "strat")
stmt("k04_zero_model", "SELECT scenario_id, count(*) AS n, count(*) AS same FROM ds60 GROUP BY ALL", "ds60")
stmt("k08_strata", "SELECT stratum, count(*) AS samples FROM strat WHERE model='dead_reckoning' AND horizon_s=60.0 GROUP BY ALL", "strat")
stmt("k09_round_trip", "SELECT 60.0::DOUBLE AS horizon_s, count(*) AS \"rows\", true AS exact FROM ds60", "ds60")
_ang = pmod(f"track_deg+degrees(atan2({_rc},{_ra}))")
_dd = f"sqrt(power({_ra},2)+power({_rc},2))"
part("pk6", f"""
SELECT *, whole AND abs(f_turn_rate_deg_s) <= 1.0 AS usable, {dest_lat('lat', 'track_deg', _D)} AS bla, {dest_lon('lat', 'lon', 'track_deg', _D)} AS blo, {_dd} AS dd, {_ang} AS ang FROM fea""", "fea")
stmt("k06_predictions_with_fallback", f"""
SELECT scenario_id, track_id, t_us, CASE WHEN usable THEN 'model' ELSE 'dead_reckoning' END AS source,
 round(CASE WHEN usable AND dd >= 1e-9 THEN {dest_lat('bla', 'ang', 'dd')} ELSE bla END,6)+0.0 AS p_lat, round(CASE WHEN usable AND dd >= 1e-9 THEN {dest_lon('bla', 'blo', 'ang', 'dd')} ELSE blo END,6)+0.0 AS p_lon,
 round(greatest(0.0, altitude_ft+vertical_rate_fpm/60.0*60.0),6)+0.0 AS p_altitude_ft FROM pk6""", "pk6")
part("terr", "SELECT scenario_id, horizon_s, model, round(round(e,4),4) AS x FROM scored WHERE phase='turn' AND model <> 'persistence'", "scored")
part("num_t", num("SELECT DISTINCT scenario_id FROM terr"), "terr")
part("pk_t", picks(400, 4242, "terr").replace("FROM num ", "FROM num_t ").replace("JOIN num ", "JOIN num_t "), "num_t")
part("draws", """
SELECT horizon_s, model, b, (max(x) FILTER (lo_hit) + max(x) FILTER (hi_hit))/2.0 AS m FROM (
 SELECT horizon_s, model, b, x, upto > (n-1)//2 AND upto-w <= (n-1)//2 AS lo_hit, upto > n//2 AND upto-w <= n//2 AS hi_hit FROM (
  SELECT horizon_s, model, b, x, w, sum(w) OVER (PARTITION BY horizon_s, model, b ORDER BY x) AS upto, sum(w) OVER (PARTITION BY horizon_s, model, b) AS n FROM (
   SELECT horizon_s, model, b, x, sum(times) AS w FROM terr JOIN pk_t USING (scenario_id) GROUP BY ALL))) GROUP BY horizon_s, model, b""", "terr", "pk_t")
stmt("e11_median_bootstrap", "SELECT horizon_s, model, count(*) AS resamples, round(quantile_cont(m,0.025),4) AS ci95_low, round(quantile_cont(m,0.975),4) AS ci95_high FROM draws GROUP BY horizon_s, model", "draws")
stmt("e11_gap_bootstrap", """
SELECT horizon_s, 'constant_turn' AS model, 'dead_reckoning' AS over, round(quantile_cont(g,0.025),4) AS ci95_low, round(quantile_cont(g,0.975),4) AS ci95_high, round(quantile_cont(g,0.025),4) > 0 AS beats
FROM (SELECT horizon_s, round((y.m-x.m)/y.m,6) AS g FROM draws x JOIN draws y USING (horizon_s, b) WHERE x.model='constant_turn' AND y.model='dead_reckoning' AND y.m > 0) GROUP BY horizon_s""", "draws")

# -- ridge regression: sums of products, then elimination column by column ----

_TARGETS = ["y_along", "y_cross", "y_alt"]
part("asg", """
SELECT d.*, s.split FROM (SELECT * FROM ds30 UNION ALL SELECT * FROM ds60 UNION ALL SELECT * FROM ds120) d JOIN (
 SELECT scenario_id, CASE WHEN idx < n_all*60//100 THEN 'train' WHEN idx < n_all*60//100 + greatest(n_all*15//100, 1) THEN 'validation' ELSE 'test_same_family' END AS split FROM numnom
 UNION ALL SELECT scenario_id, 'test_shifted' FROM scn WHERE family='shifted') s USING (scenario_id)""", "ds30", "ds60", "ds120", "numnom", "scn")
part("mom", "SELECT horizon_s, " + ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) < 1e-9 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}" for c in _FC)
     + ", " + ", ".join(f"avg({y}) AS m_{y}" for y in _TARGETS) + " FROM asg WHERE split='train' GROUP BY horizon_s", "asg")
part("zed", "SELECT horizon_s, " + ", ".join(f"({c}-m_{c})/s_{c} AS z{i}" for i, c in enumerate(_FC)) + ", " + ", ".join(f"{y}-m_{y} AS z{20 + i}" for i, y in enumerate(_TARGETS))
     + " FROM asg JOIN mom USING (horizon_s) WHERE split='train'", "asg", "mom")
part("sums", "SELECT horizon_s, [" + ", ".join("[" + ", ".join(f"sum(z{i}*z{j})" + ("+1.0" if i == j else "") for j in range(23)) + "]" for i in range(20)) + "] AS g FROM zed GROUP BY horizon_s", "zed")
part("solved", """
SELECT horizon_s, g FROM (WITH RECURSIVE step(horizon_s, k, g) AS (
 SELECT horizon_s, 1, g FROM sums
 UNION ALL SELECT horizon_s, k+1, list_transform(g, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v/g[k][k]) ELSE list_transform(r, lambda v, j: v-r[k]/g[k][k]*g[k][j]) END) FROM step WHERE k <= 20)
SELECT horizon_s, g FROM step WHERE k = 21)""", "sums")
stmt("k03_ridge_coefficients", " UNION ALL ".join(
    [f"SELECT horizon_s, '{y}' AS target, '{n}' AS feature, round(g[{i + 1}][{21 + t}],4)+0.0 AS weight FROM solved" for t, y in enumerate(_TARGETS) for i, n in enumerate(_NAMES)]
    + [f"SELECT horizon_s, '{y}', 'intercept', round(m_{y},4)+0.0 FROM mom" for y in _TARGETS]), "solved", "mom")


def ridge(t: int) -> str:
    return f"m_{_TARGETS[t]}+" + "+".join(f"({c}-m_{c})/s_{c}*g[{i + 1}][{21 + t}]" for i, c in enumerate(_FC))


part("rscored", f"""
SELECT 'dead_reckoning' AS model, split, horizon_s, phase, base_nm, sqrt(y_along*y_along+y_cross*y_cross) AS e, abs(y_alt) AS ae FROM asg WHERE split <> 'train'
UNION ALL SELECT 'ridge', split, horizon_s, phase, base_nm, sqrt(power(y_along-({ridge(0)}),2)+power(y_cross-({ridge(1)}),2)), abs(y_alt-({ridge(2)}))
FROM asg JOIN mom USING (horizon_s) JOIN solved USING (horizon_s) WHERE split <> 'train'""", "asg", "mom", "solved")
part("rstrat", """
SELECT *, 'all' AS stratum FROM rscored UNION ALL
SELECT *, CASE phase WHEN 'cruise' THEN 'cruise' WHEN 'turn' THEN 'turning' ELSE 'climbing_or_descending' END FROM rscored""", "rscored")
stmt("k03_ridge_scores", """
SELECT split, horizon_s, model, stratum, round(median(e),4) AS median_nm, round(quantile_cont(e, 0.9),4) AS p90_nm, round(avg(e),4) AS mean_nm, round(median(ae),1) AS median_altitude_ft,
 round(CASE WHEN median(base_nm) > 0 THEN (median(base_nm)-median(e))/median(base_nm) ELSE 0.0 END,4) AS skill, count(*) AS samples FROM rstrat GROUP BY split, horizon_s, model, stratum""", "rstrat")
part("pk6f", f"""
SELECT *, {dest_lat('lat', 'track_deg', _D)} AS bla, {dest_lon('lat', 'lon', 'track_deg', _D)} AS blo, sqrt(ra*ra+rc*rc) AS dd, {pmod("track_deg+degrees(atan2(rc,ra))")} AS ang FROM (
 SELECT f.*, {ridge(0)} AS ra, {ridge(1)} AS rc, {ridge(2)} AS rv FROM fea f, mom JOIN solved USING (horizon_s) WHERE horizon_s=60.0)""", "fea", "mom", "solved")
stmt("k06_fitted_predictions", f"""
SELECT scenario_id, track_id, t_us, CASE WHEN whole THEN 'model' ELSE 'dead_reckoning' END AS source,
 round(CASE WHEN whole AND dd >= 1e-9 THEN {dest_lat('bla', 'ang', 'dd')} ELSE bla END,4)+0.0 AS p_lat, round(CASE WHEN whole AND dd >= 1e-9 THEN {dest_lon('bla', 'blo', 'ang', 'dd')} ELSE blo END,4)+0.0 AS p_lon,
 round(greatest(0.0, greatest(0.0, altitude_ft+vertical_rate_fpm/60.0*60.0)+CASE WHEN whole THEN rv ELSE 0.0 END),1)+0.0 AS p_altitude_ft FROM pk6f""", "pk6f")

# -- the fitted model in the conformance chain ---------------------------------

part("cal", """
SELECT CASE model WHEN 'ridge' THEN 'model' ELSE model END AS source, 60.0::DOUBLE AS horizon_s, round(median(e),4) AS typical_nm, count(*) AS samples
FROM rscored WHERE split='test_same_family' AND phase='turn' AND horizon_s=60.0 GROUP BY model""", "rscored")
stmt("e15_served_calibration", "SELECT * FROM cal", "cal")
_USED = "whole AND dd >= 1e-9"
part("chkf", f"""
SELECT x.scenario_id, x.track_id, x.icao24, x.t_us AS predicted_us, y.t_us AS matched_us, y.callsign, x.source,
 {hav('x.plat', 'x.plon', 'y.lat', 'y.lon')} AS error_nm, {hav('x.bla', 'x.blo', 'y.lat', 'y.lon')} AS base_nm FROM (
 SELECT r.scenario_id, r.track_id, r.icao24, r.t_us, r.run_no, q.bla, q.blo, CASE WHEN whole THEN 'model' ELSE 'dead_reckoning' END AS source,
  CASE WHEN {_USED} THEN {dest_lat('q.bla', 'ang', 'dd')} ELSE q.bla END AS plat, CASE WHEN {_USED} THEN {dest_lon('q.bla', 'q.blo', 'ang', 'dd')} ELSE q.blo END AS plon,
  (SELECT min(u.t_us) FROM runr u WHERE u.scenario_id=r.scenario_id AND u.track_id=r.track_id AND u.t_us BETWEEN r.t_us+57000000 AND r.t_us+63000000) AS m_us
 FROM runr r JOIN pk6f q USING (scenario_id, track_id, t_us)) x
JOIN runr y ON y.scenario_id=x.scenario_id AND y.track_id=x.track_id AND y.t_us=x.m_us AND y.run_no=x.run_no""", "runr", "pk6f")
part("devf", """
SELECT * FROM (SELECT c.*, coalesce(greatest(1.5, 3.0*typical_nm), 1.5) AS threshold_nm FROM chkf c LEFT JOIN cal USING (source)) WHERE error_nm > threshold_nm
QUALIFY row_number() OVER (PARTITION BY scenario_id, track_id, matched_us ORDER BY error_nm DESC, predicted_us) = 1""", "chkf", "cal")
stmt("e02_fitted_deviations", f"SELECT scenario_id, track_id, matched_us, predicted_us, source, round(error_nm,3)+0.0 AS error_nm, round(base_nm,3)+0.0 AS baseline_error_nm, round(threshold_nm,3)+0.0 AS threshold_nm FROM devf", "devf")
_FITTED = {"devr": "devf", "scanr": "scanf", "cdet": "cdetf", "cisl": "cislf", "adv": "advf", "att": "attf", "cout": "coutf"}
for _old, _new in list(_FITTED.items())[1:]:
    part(_new, re.sub(r"\b(" + "|".join(_FITTED) + r")\b", lambda m: _FITTED[m[0]], PARTS[_old]), *[_FITTED.get(d, d) for d in DEPS[_old]])
stmt("k12_fitted_evaluation", f"SELECT family, kind, {_REC} FROM coutf JOIN scn USING (scenario_id) GROUP BY ALL", "coutf", "scn")
stmt("e16_predictions_by_source", "SELECT t_us//60000000*60000000 AS window_us, scenario_id, CASE WHEN whole THEN 'model' ELSE 'dead_reckoning' END AS source, count(*) AS n FROM fea GROUP BY ALL", "fea")
