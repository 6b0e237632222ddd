"""Conversation repair by plain dynamic programming over (cost, edits)."""

import hashlib
import re
import zlib
from functools import cache

STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
DUE = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def repaired(rows):
    """``rows``: those of one conversation after damage."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3][:64].encode(), hashlib.sha256(r[3].encode()).hexdigest()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0

    @cache
    def best(i, q, inserts=0):
        """Least (cost, audit, lines) from row ``i`` in state ``q``."""
        options = []
        if inserts < 3:
            cost, audit, lines = best(i, DUE[q][0], inserts + 1)
            options.append((cost + 2, "I" + audit, (DUE[q] + ":", *lines)))
        if i == len(rows):
            return min([*options, (0, "", ())] if q in ("", "a") else options or [(10**6, "", ())])
        add = lambda c, letter, to, line: options.append((c + (x := best(i + 1, to))[0], letter + x[1], (*line, *x[2])))
        add(3, "D", q, ())
        if faults[i] not in ("blank", "duplicate"):
            extra, role = faults[i] == "truncated", rows[i][2]
            add(2 + extra, "R", DUE[q][0], (f"{DUE[q]}:{rows[i][3]}",))
            if (to := STEP.get((q, role[:1]))) is not None:
                add(extra, "K", to, (f"{role}:{rows[i][3]}",))
        return min(options)

    for i in reversed(range(len(rows))):  # from the end, so that no call goes deep
        for q in ("", "s", "u", "a"):
            best(i, q)
    cost, audit, lines = best(0, "")
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def digest(rows):
    after = {r[0]: [] for r in rows}
    for r in damage(rows):
        after[r[0]].append(r)
    return {c: repaired(rs) for c, rs in after.items()}
