"""Step-by-step models of the queue and of route matching, for comparison on small inputs."""

from collections import defaultdict, deque
from datetime import datetime, timedelta
import random

START = datetime(2024, 1, 1)


def replay(rows, limit=0):
    """rows: (event_id, ts, channel, method, uid, fwd). Yields (event_id, status, q, pend, msgs)."""
    line, held, locked = defaultdict(deque), defaultdict(dict), defaultdict(set)
    for event_id, _, ch, method, uid, fwd in sorted(rows, key=lambda r: (r[1], r[0])):
        status = 200
        if method == "PUT":
            if limit and len(line[ch]) >= limit:
                status = 507
            else:
                line[ch].append(uid)
                held[ch][uid] = True
                status = 202
        elif method == "GET":
            if line[ch]:
                front = line[ch].popleft()
                locked[ch].add(front)
                status = 200 if front in held[ch] else 503
            else:
                status = 204
        elif method == "POST":
            digits = (fwd or "").strip().lstrip("+-")
            if not digits[:1].isdigit():
                status = 400
            elif int(fwd) in held[ch]:
                del held[ch][int(fwd)]
                locked[ch].discard(int(fwd))
            else:
                status = 300
        elif method == "HEAD":
            status = 200 if line[ch] else 204
        elif method != "OPTIONS":
            status = 405
        yield event_id, status, len(line[ch]), len(locked[ch]), len(held[ch])


def random_log(seed, n, channels=3, hot=0.6):
    """A log in which one channel holds most rows, with equal timestamps and repeated answers."""
    rnd = random.Random(seed)
    rows, uids, ts = [], defaultdict(list), START
    for event_id in range(n):
        ts += timedelta(seconds=rnd.choice([0, 0, 1, 30, 90]))
        ch = 0 if rnd.random() < hot else rnd.randrange(channels)
        method = rnd.choices(["PUT", "GET", "POST", "HEAD", "DELETE", "OPTIONS"], [6, 5, 4, 1, 1, 1])[0]
        uid = 1_000_000 + event_id
        fwd = None
        if method == "PUT":
            uids[ch].append(uid)
        if method == "POST":
            known = uids[ch][-4:]
            fwd = rnd.choice([None, "", "bad", "0", str(uid + 3), *map(str, known), *map(str, known)])
        rows.append((event_id, ts, ch, method, uid, fwd))
    return rows


def matches(pattern, path):
    """Walk both strings: true when either ends, at ``*`` on a difference, ``?`` eats a segment."""
    if pattern.removeprefix("/").split("/")[0] != path.removeprefix("/").split("/")[0]:
        return False
    i = j = 0
    while i < len(pattern) and j < len(path):
        if pattern[i] == path[j]:
            i, j = i + 1, j + 1
        elif pattern[i] == "?":
            if path[j] == "/":
                i += 1
            else:
                j += 1
        else:
            return pattern[i] == "*"
    return True
