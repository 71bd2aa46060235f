"""Column expressions for angles, poses, rings and tolerances. No Python runs on rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite_number(x: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def wrap_angle(a: Column) -> Column:
    """An angle in [-pi, pi)."""
    return F.pmod(a + math.pi, F.lit(2 * math.pi)) - math.pi


def angle_mod_180(deg: Column) -> Column:
    return F.pmod(deg, F.lit(180.0))


def angle_difference_deg(a: Column, b: Column) -> Column:
    """Difference of undirected lines, 0 to 90."""
    d = F.pmod(a - b, F.lit(180.0))
    return F.least(d, 180.0 - d)


def vector_angle_deg(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Angle between two vectors, 0 if one has no length."""
    n = F.hypot(ax, ay) * F.hypot(bx, by)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / n))
    return F.when(n > 0, F.degrees(F.acos(cosine))).otherwise(F.lit(0.0))


def pose_close(dx: Column, dy: Column, dyaw: Column, position: float, heading: float) -> Column:
    return (F.hypot(dx, dy) <= position) & (F.abs(wrap_angle(dyaw)) <= heading)


def to_world(x: Column, y: Column, px: Column, py: Column, yaw: Column) -> tuple[Column, Column]:
    """A point of the vehicle frame at a pose."""
    return px + x * F.cos(yaw) - y * F.sin(yaw), py + x * F.sin(yaw) + y * F.cos(yaw)


def approx_equal(a: Column, b: Column, relative: float = 1e-8, absolute: float = 1e-4) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs(a), F.abs(b)))


def sweep_tolerance(area: Column) -> Column:
    return F.greatest(F.lit(2e-4), area * 1e-8)


def compactness(area: Column, perimeter: Column) -> Column:
    return 4 * math.pi * area / (perimeter * perimeter)


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def utm(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing (no false northing) by the Krueger series to the third order on WGS84."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (utm_zone(lon) * 6 - 183))
    atanh = lambda x: F.log((1 + x) / (1 - x)) / 2
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + k0 * radius * east, k0 * radius * north


def terminal_shape(concavity: Column, reflex: Column, events: Column, fragmentation: Column) -> Column:
    """A part that is regular enough to be left whole. The six bounds."""
    resolved = (events == 0) | ((concavity <= 0.05) & (fragmentation <= 1.10))
    return resolved & (((reflex <= 1) & (concavity <= 0.10) & (fragmentation <= 1.15)) | ((concavity <= 0.040) & (reflex <= 1) & (fragmentation <= 1.35)))


def transfer_class(shifts: Column, reverse_runs: Column, winding: Column) -> Column:
    """BLOCK_TRANSFER, or null for a transfer of too many gear changes or of a full loop. The bounds."""
    return F.when((shifts <= 4) & (reverse_runs <= 2) & (winding <= 2 * math.pi - 0.1), F.lit("BLOCK_TRANSFER"))


def forward_corner(reverse_points: Column, winding: Column, net_heading: Column, extra: float = 0.08) -> Column:
    """A corner without reverse gear that turns no more than its net heading asks for."""
    return (reverse_points == 0) & (winding <= F.abs(net_heading) + extra)


def gentle_radius(dx: Column, dy: Column, yaw_a: Column, yaw_b: Column, curvature_rate: float, least_radius: float) -> Column:
    """The larger of two radii for a corner between poses, from where their tangents meet; null if there is none.

    A corner needs radius * tan(theta / 2) + 1 / (2 * rate * radius) of straight line on both sides.
    """
    theta = F.abs(wrap_angle(yaw_b - yaw_a))
    turn = F.cos(yaw_a) * F.sin(yaw_b) - F.sin(yaw_a) * F.cos(yaw_b)
    trim = F.least((dx * F.sin(yaw_b) - dy * F.cos(yaw_b)) / turn, (F.cos(yaw_a) * dy - F.sin(yaw_a) * dx) / turn)
    tangent = F.tan(theta / 2)
    inside = trim * trim - 2 * tangent / curvature_rate
    radius = (trim + F.sqrt(inside)) / (2 * tangent)
    fits = (theta >= 1e-5) & (theta <= math.pi - 1e-3) & (turn != 0)
    return F.when(fits, F.when((trim > 0) & (inside > 0), F.when(radius > least_radius * (1 + 1e-6), radius)))


def same_crs(left: Column, right: Column) -> Column:
    """Equal names, or a local metric frame on one side and any local system on the other."""
    local = lambda a, b: (a == "LOCAL_METRIC") & b.startswith("LOCAL_CS[")
    return F.coalesce((left == right) | local(left, right) | local(right, left), F.lit(False))


def stage_status(regions: Column, complete: Column, main_passed: Column, ledger_closed: Column) -> Column:
    """Status of a field's swath stage; an open area ledger takes a complete one back to partial."""
    whole = (complete == regions) & main_passed & ledger_closed
    return F.when(whole, "SWATHS_COMPLETE").when(complete > 0, "SWATHS_PARTIAL").otherwise("SWATHS_NOT_FOUND")


def dubins_length(dx: Column, dy: Column, yaw_a: Column, yaw_b: Column, radius: float) -> Column:
    """Length of the shortest forward path with bounded curvature between two poses: the least of the six words."""
    full = 2 * math.pi
    turn = lambda x: F.pmod(x, F.lit(full))
    d, theta = F.hypot(dx, dy) / radius, F.atan2(dy, dx)
    a, b = turn(yaw_a - theta), turn(yaw_b - theta)
    sa, sb, ca, cb, cab = F.sin(a), F.sin(b), F.cos(a), F.cos(b), F.cos(a - b)

    def when(p2: Column, length: Column) -> Column:
        return F.when(p2 >= 0, length)

    def root(x: Column) -> Column:
        return F.sqrt(F.greatest(x, F.lit(0.0)))

    def arc(c: Column) -> Column:
        return full - F.acos(F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0)))

    lsl, rsr = 2 + d * d - 2 * cab + 2 * d * (sa - sb), 2 + d * d - 2 * cab + 2 * d * (sb - sa)
    lsr, rsl = d * d - 2 + 2 * cab + 2 * d * (sa + sb), d * d - 2 + 2 * cab - 2 * d * (sa + sb)
    rlr, lrl = (6 - d * d + 2 * cab + 2 * d * (sa - sb)) / 8, (6 - d * d + 2 * cab + 2 * d * (sb - sa)) / 8
    to_lsl, to_rsr = F.atan2(cb - ca, d + sa - sb), F.atan2(ca - cb, d - sa + sb)
    to_lsr, to_rsl = F.atan2(-ca - cb, d + sa + sb) + F.atan2(F.lit(2.0), root(lsr)), F.atan2(ca + cb, d - sa - sb) - F.atan2(F.lit(2.0), root(rsl))
    p_rlr, p_lrl = arc(rlr), arc(lrl)
    t_rlr, t_lrl = turn(a - F.atan2(ca - cb, d - sa + sb) + p_rlr / 2), turn(-a - F.atan2(ca - cb, d + sa - sb) + p_lrl / 2)
    words = [
        when(lsl, turn(to_lsl - a) + root(lsl) + turn(b - to_lsl)),
        when(rsr, turn(a - to_rsr) + root(rsr) + turn(to_rsr - b)),
        when(lsr, turn(to_lsr - a) + root(lsr) + turn(to_lsr - b)),
        when(rsl, turn(a - to_rsl) + root(rsl) + turn(b - to_rsl)),
        when(1 - F.abs(rlr), t_rlr + p_rlr + turn(a - b - t_rlr + p_rlr)),
        when(1 - F.abs(lrl), t_lrl + p_lrl + turn(b - a - t_lrl + p_lrl)),
    ]
    return F.least(*words) * radius
