"""Plain reference computations over small lists."""

import math

A, F = 6378137.0, 1 / 298.257223563
B = A * (1 - F)


def geodesic(lat1, lon1, lat2, lon2):
    """Vincenty inverse, one pair, iterated until it no longer moves."""
    if (lat1, lon1) == (lat2, lon2):
        return 0.0
    u1, u2 = (math.atan((1 - F) * math.tan(math.radians(x))) for x in (lat1, lat2))
    big_l = math.radians(lon2 - lon1)
    lam = big_l
    for _ in range(200):
        ss = math.sqrt((math.cos(u2) * math.sin(lam)) ** 2
                       + (math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam)) ** 2)
        cs = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        sigma = math.atan2(ss, cs)
        sa = math.cos(u1) * math.cos(u2) * math.sin(lam) / ss
        c2 = 1 - sa * sa
        cm = cs - 2 * math.sin(u1) * math.sin(u2) / c2 if c2 else 0.0
        c = F / 16 * c2 * (4 + F * (4 - 3 * c2))
        new = big_l + (1 - c) * F * sa * (sigma + c * ss * (cm + c * cs * (-1 + 2 * cm * cm)))
        if abs(new - lam) < 1e-15:
            break
        lam = new
    q = c2 * (A * A - B * B) / (B * B)
    k1 = 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q)))
    k2 = q / 1024 * (256 + q * (-128 + q * (74 - 47 * q)))
    ds = k2 * ss * (cm + k2 / 4 * (cs * (-1 + 2 * cm * cm) - k2 / 6 * cm * (-3 + 4 * ss * ss) * (-3 + 4 * cm * cm)))
    return B * k1 * (sigma - ds)


def greedy(points, radius):
    """Near-duplicate pass in key order over ``(key, category, lat, lon)``; returns the kept keys."""
    kept = []
    for category in {p[1] for p in points}:
        rows = sorted(p for p in points if p[1] == category)
        live = list(rows)
        for row in rows:
            hit = next((o for o in live if o[0] != row[0] and geodesic(*row[2:], *o[2:]) < radius), None)
            if hit is None:
                kept.append(row[0])
            else:
                live.remove(hit)
    return sorted(kept)
