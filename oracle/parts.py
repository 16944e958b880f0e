"""Named common table expressions the oracle statements are assembled from."""

from __future__ import annotations

EPOCH = 1704067200000000
R = 3440.0695
# First multiple of ten seconds at or after the last report.
END = f"(SELECT {EPOCH} + CAST(ceil((epoch_us(max(ts))-{EPOCH})//10000/10000000.0) AS BIGINT)*10000000 FROM events)"


def hav(a, b, c, d):
    q = (
        f"sqrt(power(sin((radians({c})-radians({a}))/2.0),2)"
        f"+cos(radians({a}))*cos(radians({c}))*power(sin(radians(({d})-({b}))/2.0),2))"
    )
    return f"(2.0*{R}*asin(CASE WHEN {q} > 1.0 THEN 1.0 ELSE {q} END))"


def pmod(x, m="360.0"):
    return f"((({x}) % {m}) + {m}) % {m}"


def wrap180(x):
    return f"({pmod(f'({x})+180.0')} - 180.0)"


def bdiff(a, b):
    d = f"({pmod(f'({b})-({a})+180.0')} - 180.0)"
    return f"(CASE WHEN {d} <= -180.0 THEN {d}+360.0 ELSE {d} END)"


def enu_e(rla, rlo, la, lo):
    return f"(radians({wrap180(f'({lo})-({rlo})')})*cos(radians((({rla})+({la}))/2.0))*{R})"


def enu_n(rla, la):
    return f"(radians(({la})-({rla}))*{R})"


def un_lat(rla, n):
    return f"(({rla})+degrees(({n})/{R}))"


def un_lon(rla, rlo, e, n):
    return wrap180(f"({rlo})+degrees(({e})/({R}*cos(radians((({rla})+{un_lat(rla, n)})/2.0))))")


def _sin_lat2(la, brg, d):
    x = f"(sin(radians({la}))*cos(({d})/{R})+cos(radians({la}))*sin(({d})/{R})*cos(radians({brg})))"
    return f"(CASE WHEN {x} > 1.0 THEN 1.0 WHEN {x} < -1.0 THEN -1.0 ELSE {x} END)"


def dest_lat(la, brg, d):
    return f"degrees(asin({_sin_lat2(la, brg, d)}))"


def dest_lon(la, lo, brg, d):
    s = _sin_lat2(la, brg, d)
    return wrap180(
        f"degrees(radians({lo})+atan2(sin(radians({brg}))*sin(({d})/{R})*cos(radians({la})),"
        f"cos(({d})/{R})-sin(radians({la}))*({s})))"
    )


def bearing(a, b, c, d):
    y = f"(sin(radians(({d})-({b})))*cos(radians({c})))"
    x = (
        f"(cos(radians({a}))*sin(radians({c}))-sin(radians({a}))*cos(radians({c}))"
        f"*cos(radians(({d})-({b}))))"
    )
    return f"(CASE WHEN {x}=0.0 AND {y}=0.0 THEN 0.0 ELSE {pmod(f'degrees(atan2({y},{x}))')} END)"


_KIN = """
  40.6 AS lat0, ((s % 24) * 10.0 - 120.0) AS lon0,
  CAST((i*137 + s*11) % 360 AS DOUBLE) AS brg,
  CAST((i*29 + s*7) % 40 AS DOUBLE) + 12.0 AS start_nm,
  CAST((i*53 + s*17) % 120 AS DOUBLE) + 380.0 AS speed,
  (i % 3 = 0) AS turner,
  CASE WHEN i % 5 = 0 THEN 1500.0 WHEN i % 5 = 1 THEN -1500.0 ELSE 0.0 END AS climb,
  CASE WHEN i % 20 = 7 THEN -6500.0 ELSE 0.0 END AS dive
"""

_STATE = f"""
  CASE WHEN turner THEN start_nm*sin(radians(brg)) + speed/3600.0*least(t,120.0)*sin(radians(brg+180.0))
     + (speed/3600.0/radians(3.0))*(cos(radians(brg+180.0)) - cos(radians(brg+180.0) + least(greatest(t-120.0,0.0),30.0)*radians(3.0)))
     + speed/3600.0*greatest(t-150.0,0.0)*sin(radians(brg+180.0)+radians(90.0))
   ELSE start_nm*sin(radians(brg)) + speed/3600.0*t*sin(radians(brg+180.0)) END AS east,
  CASE WHEN turner THEN start_nm*cos(radians(brg)) + speed/3600.0*least(t,120.0)*cos(radians(brg+180.0))
     + (speed/3600.0/radians(3.0))*(sin(radians(brg+180.0) + least(greatest(t-120.0,0.0),30.0)*radians(3.0)) - sin(radians(brg+180.0)))
     + speed/3600.0*greatest(t-150.0,0.0)*cos(radians(brg+180.0)+radians(90.0))
   ELSE start_nm*cos(radians(brg)) + speed/3600.0*t*cos(radians(brg+180.0)) END AS north,
  CASE WHEN turner THEN brg+180.0+least(greatest(t-120.0,0.0),30.0)*3.0 ELSE brg+180.0 END AS heading,
  30000.0 + ((i+s)%5)*1000.0 + (i%3)*400.0 + climb*least(t,120.0)/60.0
     + dive*least(greatest(t-60.0,0.0),30.0)/60.0 AS altitude,
  CAST((CASE WHEN t < 120.0 THEN climb ELSE 0.0 END)
     + (CASE WHEN t >= 60.0 AND t < 90.0 THEN dive ELSE 0.0 END) AS DOUBLE) AS vrate,
  CASE WHEN turner AND t >= 120.0 AND t < 150.0 THEN (150.0-t)*3.0 ELSE 0.0 END AS turning_deg
"""


def _noise(a, b):
    return f"((((event_id*{a}+{b}) % 10007)/10007.0*2.0-1.0)*sqrt(3.0))"


PARTS: dict[str, str] = {}

PARTS["ev"] = f"""
SELECT *, {EPOCH} + CAST(floor((epoch_us(ts)-{EPOCH})/10000.0) AS BIGINT) AS t_us,
  user_id % 8 AS s, user_id // 8 AS i,
  'sector-' || CAST(user_id % 8 AS VARCHAR) AS scenario_id,
  lpad(lower(to_hex(user_id)), 6, '0') AS icao24
FROM events
"""

PARTS["rep0"] = f"""
SELECT *, {_STATE} FROM (SELECT *, (t_us-{EPOCH})/1000000.0 AS t, {_KIN} FROM ev)
"""
_ne, _nn = f"(east+{_noise(7919, 11)}*(30.0/1852.0))", f"(north+{_noise(6101, 503)}*(30.0/1852.0))"
PARTS["rep"] = f"""
SELECT scenario_id, scenario_id || '-' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS report_id, icao24,
  CASE WHEN event_type <> 'click' THEN 'AC' || lpad(CAST(user_id AS VARCHAR), 6, '0') END AS callsign,
  t_us,
  round({un_lat('lat0', _nn)}, 6) AS lat,
  round({un_lon('lat0', 'lon0', _ne, _nn)}, 6) AS lon,
  CASE WHEN event_type <> 'error' THEN round(altitude+{_noise(4603, 29)}*25.0, 2) END AS altitude_baro_ft,
  CASE WHEN event_type <> 'signup' THEN round(speed+{_noise(3571, 71)}*2.0, 2) END AS ground_speed_kt,
  CASE WHEN event_type <> 'signup' THEN round({pmod(f'round(heading+{_noise(2741, 97)}*0.5, 2)')}, 2) END AS track_deg,
  CASE WHEN event_type <> 'signup' THEN vrate END AS vertical_rate_fpm,
  CASE WHEN event_type = 'purchase' AND value >= 150.0 THEN '7700' WHEN event_type = 'view' THEN '1200' END AS squawk,
  false AS on_ground
FROM rep0
"""

PARTS["act"] = """
SELECT user_id, s, i, scenario_id, icao24, min(t_us) AS first_us, max(t_us) AS last_us FROM ev GROUP BY ALL
"""
PARTS["tru"] = f"""
SELECT scenario_id, icao24, sec,
  round({un_lat('lat0', 'north')}, 6) AS lat, round({un_lon('lat0', 'lon0', 'east', 'north')}, 6) AS lon,
  round(altitude, 2) AS altitude_ft, speed AS ground_speed_kt,
  round({pmod('round(heading, 2)')}, 2) AS track_deg, vrate AS vertical_rate_fpm,
  CASE WHEN vrate > 300.0 THEN 'climb' WHEN vrate < -300.0 THEN 'descent'
       WHEN abs(turning_deg) > 1.0 THEN 'turn' ELSE 'cruise' END AS phase
FROM (SELECT *, {_STATE} FROM (
  SELECT *, CAST(sec AS DOUBLE) AS t, {_KIN} FROM (
    SELECT *, CAST(unnest(generate_series(
       CAST(ceil((first_us-{EPOCH})/1000000.0) AS INT),
       CAST(greatest(ceil((first_us-{EPOCH})/1000000.0), floor((last_us-{EPOCH})/1000000.0)) AS INT))) AS INT) AS sec
    FROM act)))
"""

PARTS["plan"] = """
SELECT scenario_id, icao24, 0.0::DOUBLE AS at_s, 'ClimbTo' AS kind FROM act WHERE i % 5 IN (0, 1)
UNION ALL SELECT scenario_id, icao24, 60.0::DOUBLE, 'ClimbTo' FROM act WHERE i % 20 = 7
UNION ALL SELECT scenario_id, icao24, 120.0::DOUBLE, 'ClimbTo' FROM act WHERE i % 5 IN (0, 1)
UNION ALL SELECT scenario_id, icao24, 120.0::DOUBLE, 'TurnTo' FROM act WHERE i % 3 = 0
"""

# Flights: deduplicated reports, 30 s silences split, origin fixed per flight.
PARTS["seg"] = """
SELECT *, round_even(first_value(lat) OVER w, 0) AS rla, round_even(first_value(lon) OVER w, 0) AS rlo,
  first_value(t_us) OVER w AS segment_us, row_number() OVER w AS rn,
  last_value(callsign IGNORE NULLS) OVER w AS cs, last_value(squawk IGNORE NULLS) OVER w AS sq
FROM (
  SELECT *, sum(CASE WHEN dt IS NULL OR dt >= 30.0 THEN 1 ELSE 0 END)
      OVER (PARTITION BY scenario_id, icao24 ORDER BY t_us) AS seg_no
  FROM (
    SELECT *, (t_us - lag(t_us) OVER k)/1000000.0 AS dt, (lead(t_us) OVER k - t_us)/1000000.0 AS gap
    FROM (SELECT * FROM rep QUALIFY row_number() OVER (PARTITION BY scenario_id, icao24, t_us ORDER BY report_id) = 1)
    WINDOW k AS (PARTITION BY scenario_id, icao24 ORDER BY t_us)))
WINDOW w AS (PARTITION BY scenario_id, icao24, seg_no ORDER BY t_us)
"""
PARTS["meas"] = f"""
SELECT *, {enu_e('rla', 'rlo', 'lat', 'lon')} AS me, {enu_n('rla', 'lat')} AS mn,
  ground_speed_kt*sin(radians(track_deg)) AS mve, ground_speed_kt*cos(radians(track_deg)) AS mvn,
  altitude_baro_ft AS mz, vertical_rate_fpm AS mw
FROM seg
"""

_PRED = """
 k.e + m.dt/3600.0*k.ve AS e, k.n + m.dt/3600.0*k.vn AS n, k.ve, k.vn, k.z + m.dt/60.0*k.w AS z, k.w,
 k.hpp + 2.0*(m.dt/3600.0)*k.hpv + (m.dt/3600.0)*(m.dt/3600.0)*k.hvv + power(0.5*m.dt*m.dt/3600.0,2)*9.0 AS hpp,
 k.hpv + (m.dt/3600.0)*k.hvv + (0.5*m.dt*m.dt/3600.0)*m.dt*9.0 AS hpv,
 k.hvv + m.dt*m.dt*9.0 AS hvv,
 k.zpp + 2.0*(m.dt/60.0)*k.zpv + (m.dt/60.0)*(m.dt/60.0)*k.zvv + power(0.5*m.dt*m.dt/60.0,2)*3600.0 AS zpp,
 k.zpv + (m.dt/60.0)*k.zvv + (0.5*m.dt*m.dt/60.0)*m.dt*3600.0 AS zpv,
 k.zvv + m.dt*m.dt*3600.0 AS zvv
"""
_RP, _RV, _RZ, _RW = "power(30.0/1852.0,2)", "4.0", "625.0", "10000.0"
PARTS["kal"] = f"""
SELECT scenario_id, icao24, seg_no, rn, me AS e, mn AS n, coalesce(mve,0.0) AS ve, coalesce(mvn,0.0) AS vn,
  coalesce(mz,0.0) AS z, coalesce(mw,0.0) AS w, 1.0::DOUBLE AS hpp, 0.0::DOUBLE AS hpv, 2500.0::DOUBLE AS hvv,
  40000.0::DOUBLE AS zpp, 0.0::DOUBLE AS zpv, 250000.0::DOUBLE AS zvv, 0.0::DOUBLE AS innov
FROM meas WHERE rn = 1
UNION ALL
SELECT scenario_id, icao24, seg_no, rn,
  e + hk1*(me-e) + hk2*coalesce(mve-ve,0.0), n + hk1*(mn-n) + hk2*coalesce(mvn-vn,0.0),
  ve + hk3*(me-e) + hk4*coalesce(mve-ve,0.0), vn + hk3*(mn-n) + hk4*coalesce(mvn-vn,0.0),
  z + zk1*coalesce(mz-z,0.0) + zk2*coalesce(mw-w,0.0), w + zk3*coalesce(mz-z,0.0) + zk4*coalesce(mw-w,0.0),
  hk1*{_RP},
  CASE WHEN mve IS NOT NULL THEN hk2*{_RV} ELSE hk3*{_RP} END,
  CASE WHEN mve IS NOT NULL THEN hk4*{_RV} ELSE hvv - hk3*hpv END,
  CASE WHEN mz IS NOT NULL THEN zk1*{_RZ} ELSE zpp - zk2*zpv END,
  CASE WHEN mw IS NOT NULL THEN zk2*{_RW} WHEN mz IS NOT NULL THEN zk3*{_RZ} ELSE zpv END,
  CASE WHEN mw IS NOT NULL THEN zk4*{_RW} ELSE zvv - zk3*zpv END,
  sqrt(power(me-e,2)+power(mn-n,2))
FROM (
 SELECT *,
  CASE WHEN mve IS NOT NULL THEN (hpp*(hvv+{_RV})-hpv*hpv)/hdet ELSE hpp/(hpp+{_RP}) END AS hk1,
  CASE WHEN mve IS NOT NULL THEN hpv*{_RP}/hdet ELSE 0.0 END AS hk2,
  CASE WHEN mve IS NOT NULL THEN hpv*{_RV}/hdet ELSE hpv/(hpp+{_RP}) END AS hk3,
  CASE WHEN mve IS NOT NULL THEN (hvv*(hpp+{_RP})-hpv*hpv)/hdet ELSE 0.0 END AS hk4,
  CASE WHEN mz IS NOT NULL AND mw IS NOT NULL THEN (zpp*(zvv+{_RW})-zpv*zpv)/zdet WHEN mz IS NOT NULL THEN zpp/(zpp+{_RZ}) ELSE 0.0 END AS zk1,
  CASE WHEN mz IS NOT NULL AND mw IS NOT NULL THEN zpv*{_RZ}/zdet WHEN mw IS NOT NULL THEN zpv/(zvv+{_RW}) ELSE 0.0 END AS zk2,
  CASE WHEN mz IS NOT NULL AND mw IS NOT NULL THEN zpv*{_RW}/zdet WHEN mz IS NOT NULL THEN zpv/(zpp+{_RZ}) ELSE 0.0 END AS zk3,
  CASE WHEN mz IS NOT NULL AND mw IS NOT NULL THEN (zvv*(zpp+{_RZ})-zpv*zpv)/zdet WHEN mw IS NOT NULL THEN zvv/(zvv+{_RW}) ELSE 0.0 END AS zk4
 FROM (SELECT *, (hpp+{_RP})*(hvv+{_RV})-hpv*hpv AS hdet, (zpp+{_RZ})*(zvv+{_RW})-zpv*zpv AS zdet FROM (
   SELECT m.scenario_id, m.icao24, m.seg_no, m.rn, m.me, m.mn, m.mve, m.mvn, m.mz, m.mw, {_PRED}
   FROM kal k JOIN meas m ON m.scenario_id=k.scenario_id AND m.icao24=k.icao24 AND m.seg_no=k.seg_no AND m.rn=k.rn+1)))
"""

_OUT = f"""
 scenario_id, icao24, 'trk-' || icao24 AS track_id, cs AS callsign, t_us, last_report_us, segment_us, state,
 {un_lat('rla', 'n')} AS lat, {un_lon('rla', 'rlo', 'e', 'n')} AS lon, greatest(0.0, z) AS altitude_ft,
 sqrt(ve*ve+vn*vn) AS ground_speed_kt, {pmod('degrees(atan2(ve,vn))')} AS track_deg, w AS vertical_rate_fpm,
 turn_rate_deg_s, sqrt(2.0*hpp)*1852.0 AS position_uncertainty_m, sqrt(hvv) AS velocity_uncertainty_kt,
 sqrt(zpp) AS altitude_uncertainty_ft, sqrt(zvv) AS vertical_rate_uncertainty_fpm,
 CAST(rn AS INT) AS update_count, innov AS innovation_nm, sq AS squawk
"""
PARTS["est"] = f"""
SELECT k.*, m.t_us, m.dt, coalesce(m.gap, ({END}-m.t_us)/1000000.0) AS gap, m.rla, m.rlo, m.segment_us, m.cs, m.sq, m.t_us AS last_report_us,
  CASE WHEN k.rn >= 3 THEN 'confirmed' ELSE 'initiating' END AS state,
  CASE WHEN k.rn = 1 THEN 0.0 ELSE {bdiff('lag(' + pmod('degrees(atan2(k.ve,k.vn))') + ') OVER w', pmod('degrees(atan2(k.ve,k.vn))'))}/m.dt END AS turn_rate_deg_s
FROM kal k JOIN meas m USING (scenario_id, icao24, seg_no, rn)
WINDOW w AS (PARTITION BY scenario_id, icao24, seg_no ORDER BY rn)
"""


def _ahead(a, state):
    return f"""
SELECT * REPLACE (e + {a}/3600.0*ve AS e, n + {a}/3600.0*vn AS n, z + {a}/60.0*w AS z,
 hpp + 2.0*({a}/3600.0)*hpv + power({a}/3600.0,2)*hvv + power(0.5*{a}*{a}/3600.0,2)*9.0 AS hpp,
 hvv + {a}*{a}*9.0 AS hvv,
 zpp + 2.0*({a}/60.0)*zpv + power({a}/60.0,2)*zvv + power(0.5*{a}*{a}/60.0,2)*3600.0 AS zpp,
 zvv + {a}*{a}*3600.0 AS zvv, t_us + {int(float(a) * 1e6)} AS t_us, '{state}' AS state)
FROM est WHERE gap >= {a}"""


# Replay view (reports only) and live view (with silence-driven rows).
PARTS["upd"] = f"SELECT {_OUT} FROM est"
PARTS["trk"] = f"""
SELECT {_OUT} FROM (SELECT * FROM est UNION ALL {_ahead('5.0', 'coasting')} UNION ALL {_ahead('30.0', 'terminated')})
"""

DEPS: dict[str, list[str]] = {
    "ev": [], "rep0": ["ev"], "rep": ["rep0"], "act": ["ev"], "tru": ["act"], "plan": ["act"],
    "seg": ["rep"], "meas": ["seg"], "kal": ["meas"], "est": ["kal", "meas"], "upd": ["est"], "trk": ["est"],
}


def part(name: str, sql: str, *deps: str) -> None:
    PARTS[name] = sql
    DEPS[name] = list(deps)


def statement(body: str, *needs: str) -> str:
    """`body` preceded by every part it (transitively) needs."""
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in DEPS[n]:
            visit(d)
        seen.append(n)

    for n in needs:
        visit(n)
    if not seen:
        return body
    ctes = ",\n".join(
        f"{n} AS {'' if n in ('kal', 'beat', 'legs') else 'MATERIALIZED '}({PARTS[n]})" for n in seen
    )
    return f"WITH RECURSIVE {ctes}\n{body}"
