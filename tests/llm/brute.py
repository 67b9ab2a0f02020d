"""Plain Python versions of operators, to hold results against."""

import hashlib
import heapq
import zlib

SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    """Conversations (conv_id -> rows) after the faults of op13, of (conv_id, turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        mine += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def conversation(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit and the repaired
    rows of one conversation of (turn, role, text), by Dijkstra's algorithm over
    (cost, edits so far)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    turns = [t for t, _, _ in rows if t is not None]
    seen, fault = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        fault.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    heads = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:]))
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, made = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        nxt, role = (3, "assistant") if state == 2 else (2, "user")
        heapq.heappush(heap, (cost + 3, audit + "I", i, nxt, made + ((role, ""),)))
        if i < len(rows):
            _, own, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, made))
            if fault[i] in ("", "truncated"):
                more = 3 * (fault[i] == "truncated")
                heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, nxt, made + ((role, text),)))
                if own[:1] == "s" and state == 0:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, 1, made + ((own, text),)))
                elif own[:1] == role[0]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, nxt, made + ((own, text),)))
    counts = [fault.count(f) for f in ("blank", "duplicate", "truncated")]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *counts, illegal, cost, audit), list(made)


def digest(made):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
