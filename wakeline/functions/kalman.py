"""Constant-velocity filter arithmetic, vectorised over independent flights.

The six-state model splits into three 2x2 problems (east, north, vertical), and
east and north always share one covariance. A bank of flights is therefore a
matrix with one row per flight and twelve columns, and one call advances every
flight in it. There is no Spark in here and no I/O.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

# Columns of a bank: means, then horizontal and vertical covariance triples.
E, N, VE, VN, Z, W, HPP, HPV, HVV, ZPP, ZPV, ZVV = range(12)
WIDTH = 12
KT = 1.0 / 3600.0  # knots -> NM per second
FPM = 1.0 / 60.0  # feet per minute -> feet per second


@dataclass(frozen=True)
class Tuning:
    """Noise assumptions; the defaults are fixed values results depend on."""

    accel_kt_s: float = 3.0
    vertical_accel_fpm_s: float = 60.0
    position_nm: float = 30.0 / 1852.0
    altitude_ft: float = 25.0
    speed_kt: float = 2.0
    vertical_rate_fpm: float = 100.0
    initial_position_nm: float = 1.0
    initial_velocity_kt: float = 50.0
    initial_altitude_ft: float = 200.0
    initial_vertical_rate_fpm: float = 500.0


@dataclass
class Measured:
    """Projected measurements; NaN marks a field the report did not carry."""

    east: np.ndarray
    north: np.ndarray
    v_east: np.ndarray
    v_north: np.ndarray
    altitude: np.ndarray
    vrate: np.ndarray

    def take(self, idx) -> "Measured":
        return Measured(*(getattr(self, f)[idx] for f in self.__dataclass_fields__))


def initial(m: Measured, tuning: Tuning) -> np.ndarray:
    """Bank for flights seen for the first time; missing fields start at zero."""
    bank = np.zeros((len(m.east), WIDTH))
    bank[:, E], bank[:, N] = m.east, m.north
    for c, v in ((VE, m.v_east), (VN, m.v_north), (Z, m.altitude), (W, m.vrate)):
        bank[:, c] = np.nan_to_num(v, nan=0.0)
    bank[:, HPP] = tuning.initial_position_nm**2
    bank[:, HVV] = tuning.initial_velocity_kt**2
    bank[:, ZPP] = tuning.initial_altitude_ft**2
    bank[:, ZVV] = tuning.initial_vertical_rate_fpm**2
    return bank


def _drift(bank, dt, pp, pv, vv, unit, accel) -> None:
    c, g = unit * dt, 0.5 * unit * dt * dt
    a2 = accel * accel
    bank[:, pp] += 2.0 * c * bank[:, pv] + c * c * bank[:, vv] + g * g * a2
    bank[:, pv] += c * bank[:, vv] + g * dt * a2
    bank[:, vv] += dt * dt * a2


def predict(bank: np.ndarray, dt: np.ndarray, tuning: Tuning) -> None:
    """Propagate in place by `dt` seconds (one value per flight, >= 0)."""
    bank[:, E] += KT * dt * bank[:, VE]
    bank[:, N] += KT * dt * bank[:, VN]
    bank[:, Z] += FPM * dt * bank[:, W]
    _drift(bank, dt, HPP, HPV, HVV, KT, tuning.accel_kt_s)
    _drift(bank, dt, ZPP, ZPV, ZVV, FPM, tuning.vertical_accel_fpm_s)


def _gains(bank, pp, pv, vv, r_pos, r_vel, has_pos, has_vel):
    """Gain matrix and posterior covariance for every presence pattern."""
    p, c, v = bank[:, pp], bank[:, pv], bank[:, vv]
    det = (p + r_pos) * (v + r_vel) - c * c
    both, only_p, only_v = has_pos & has_vel, has_pos & ~has_vel, has_vel & ~has_pos
    kpp = np.where(both, (p * (v + r_vel) - c * c) / det, np.where(only_p, p / (p + r_pos), 0.0))
    kpv = np.where(both, c * r_pos / det, np.where(only_v, c / (v + r_vel), 0.0))
    kvp = np.where(both, c * r_vel / det, np.where(only_p, c / (p + r_pos), 0.0))
    kvv = np.where(both, (v * (p + r_pos) - c * c) / det, np.where(only_v, v / (v + r_vel), 0.0))
    # With both components measured the posterior is simply gain times noise.
    post_pp = np.where(has_pos, kpp * r_pos, p - kpv * c)
    post_pv = np.where(both, kpv * r_vel, np.where(only_p, kvp * r_pos, np.where(only_v, kpv * r_vel, c)))
    post_vv = np.where(has_vel, kvv * r_vel, v - kvp * c)
    return (kpp, kpv, kvp, kvv), (post_pp, post_pv, post_vv)


def correct(bank: np.ndarray, m: Measured, tuning: Tuning) -> np.ndarray:
    """Fold one report per flight into the bank; returns the position surprise."""
    has_v = ~np.isnan(m.v_east)
    de, dn = m.east - bank[:, E], m.north - bank[:, N]
    dve = np.where(has_v, m.v_east - bank[:, VE], 0.0)
    dvn = np.where(has_v, m.v_north - bank[:, VN], 0.0)
    always = np.ones(len(bank), dtype=bool)
    (kpp, kpv, kvp, kvv), cov = _gains(
        bank, HPP, HPV, HVV, tuning.position_nm**2, tuning.speed_kt**2, always, has_v
    )
    bank[:, E] += kpp * de + kpv * dve
    bank[:, N] += kpp * dn + kpv * dvn
    bank[:, VE] += kvp * de + kvv * dve
    bank[:, VN] += kvp * dn + kvv * dvn
    bank[:, HPP], bank[:, HPV], bank[:, HVV] = cov

    has_z, has_w = ~np.isnan(m.altitude), ~np.isnan(m.vrate)
    dz = np.where(has_z, m.altitude - bank[:, Z], 0.0)
    dw = np.where(has_w, m.vrate - bank[:, W], 0.0)
    (kpp, kpv, kvp, kvv), cov = _gains(
        bank, ZPP, ZPV, ZVV, tuning.altitude_ft**2, tuning.vertical_rate_fpm**2, has_z, has_w
    )
    bank[:, Z] += kpp * dz + kpv * dw
    bank[:, W] += kvp * dz + kvv * dw
    bank[:, ZPP], bank[:, ZPV], bank[:, ZVV] = cov
    return np.hypot(de, dn)


def follow(start: np.ndarray, dt: np.ndarray, m: Measured, t: Tuning) -> tuple[np.ndarray, np.ndarray]:
    """States and surprises of one flight over successive reports, in plain floats.

    The same arithmetic as `predict` and `correct`; with only a few flights at
    hand, one-row arrays cost far more than the numbers in them.
    """
    e, n, ve, vn, z, w, hpp, hpv, hvv, zpp, zpv, zvv = (float(x) for x in start)
    rp, rv, rz, rw = t.position_nm**2, t.speed_kt**2, t.altitude_ft**2, t.vertical_rate_fpm**2
    ah, av = t.accel_kt_s**2, t.vertical_accel_fpm_s**2
    states, surprise = [], []
    for d, me, mn, mve, mvn, mz, mw in zip(*(x.tolist() for x in (dt, m.east, m.north, m.v_east, m.v_north, m.altitude, m.vrate))):
        c, g = KT * d, 0.5 * KT * d * d
        e, n = e + c * ve, n + c * vn
        hpp += 2.0 * c * hpv + c * c * hvv + g * g * ah
        hpv += c * hvv + g * d * ah
        hvv += d * d * ah
        c, g = FPM * d, 0.5 * FPM * d * d
        z += c * w
        zpp += 2.0 * c * zpv + c * c * zvv + g * g * av
        zpv += c * zvv + g * d * av
        zvv += d * d * av
        de, dn = me - e, mn - n
        surprise.append(math.hypot(de, dn))
        if mve == mve:
            dve, dvn = mve - ve, mvn - vn
            det = (hpp + rp) * (hvv + rv) - hpv * hpv
            kpp, kpv = (hpp * (hvv + rv) - hpv * hpv) / det, hpv * rp / det
            kvp, kvv = hpv * rv / det, (hvv * (hpp + rp) - hpv * hpv) / det
            e, n = e + kpp * de + kpv * dve, n + kpp * dn + kpv * dvn
            ve, vn = ve + kvp * de + kvv * dve, vn + kvp * dn + kvv * dvn
            hpp, hpv, hvv = kpp * rp, kpv * rv, kvv * rv
        else:
            kpp, kvp = hpp / (hpp + rp), hpv / (hpp + rp)
            e, n, ve, vn = e + kpp * de, n + kpp * dn, ve + kvp * de, vn + kvp * dn
            hpp, hpv, hvv = kpp * rp, kvp * rp, hvv - kvp * hpv
        dz, dw = mz - z, mw - w
        if mz == mz and mw == mw:
            det = (zpp + rz) * (zvv + rw) - zpv * zpv
            kpp, kpv = (zpp * (zvv + rw) - zpv * zpv) / det, zpv * rz / det
            kvp, kvv = zpv * rw / det, (zvv * (zpp + rz) - zpv * zpv) / det
            z, w = z + kpp * dz + kpv * dw, w + kvp * dz + kvv * dw
            zpp, zpv, zvv = kpp * rz, kpv * rw, kvv * rw
        elif mz == mz:
            kpp, kvp = zpp / (zpp + rz), zpv / (zpp + rz)
            z, w = z + kpp * dz, w + kvp * dz
            zpp, zpv, zvv = kpp * rz, kvp * rz, zvv - kvp * zpv
        elif mw == mw:
            kpv, kvv = zpv / (zvv + rw), zvv / (zvv + rw)
            z, w = z + kpv * dw, w + kvv * dw
            zpp, zpv, zvv = zpp - kpv * zpv, kpv * rw, kvv * rw
        states.append((e, n, ve, vn, z, w, hpp, hpv, hvv, zpp, zpv, zvv))
    return np.array(states), np.array(surprise)
