"""Plain-Python statements of the fill rules, used as test oracles."""

from __future__ import annotations


def fill_two_sided(vals, xs, limit=None):
    """Missing rows filled on the line through the nearest present rows before and
    after (x = ``xs``); with ``limit`` only if within ``limit`` rows of either;
    edges copy the single neighbour."""
    n = len(vals)
    present = [i for i, v in enumerate(vals) if v is not None]
    out = list(vals)
    for i in range(n):
        if vals[i] is not None:
            continue
        p = max((j for j in present if j < i), default=None)
        q = min((j for j in present if j > i), default=None)
        okp = p is not None and (limit is None or i - p <= limit)
        okq = q is not None and (limit is None or q - i <= limit)
        if not (okp or okq):
            continue
        if p is not None and q is not None:
            out[i] = vals[p] + (vals[q] - vals[p]) * (xs[i] - xs[p]) / (xs[q] - xs[p])
        elif p is not None:
            out[i] = vals[p]
        else:
            out[i] = vals[q]
    return out


def ffill(vals):
    out, last = [], None
    for v in vals:
        last = v if v is not None else last
        out.append(last)
    return out
