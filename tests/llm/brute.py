"""Plain single-machine versions of the corpus operators' definitions, for small tables."""

import collections
import hashlib
import itertools
import math
import re
import zlib

LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACES = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def letter_words(text):
    return LETTERS.findall((text or "").translate(LOWER))


def licenses(text, phrases):
    words = letter_words(text)
    at = []
    for phrase, label in phrases.items():
        parts = phrase.split()
        at += [(i, label) for i in range(len(words) - len(parts) + 1) if words[i: i + len(parts)] == parts]
    return len(words), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))


def contamination(docs, items, size=10):
    windows = collections.defaultdict(set)
    for item, text in items:
        words = letter_words(text)
        m = min(size, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            windows[tuple(words[i: i + m])].add(item)
    out = []
    for doc, text in docs:
        words, hit, found = letter_words(text), set(), set()
        for m in {len(w) for w in windows}:
            for i in range(len(words) - m + 1):
                if tuple(words[i: i + m]) in windows:
                    found |= windows[tuple(words[i: i + m])]
                    hit |= set(range(i, i + m))
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), digest, bool(hit)))
    return out


def repeats(docs, size=35):
    texts = [SPACES.findall(text or "") for _, text in docs]
    count = collections.Counter(tuple(w[i: i + size]) for w in texts for i in range(len(w) - size + 1))
    out = []
    for (doc, _), words in zip(docs, texts):
        gone = set()
        for i in range(len(words) - size + 1):
            if count[tuple(words[i: i + size])] > 1:
                gone |= set(range(i, i + size))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def near_classes(docs):
    """[(id, class id)] by comparing all pairs."""
    bags = []
    for _, text in docs:
        words = tuple(letter_words(text))
        bags.append(collections.Counter(words[i: i + 5] for i in range(max(1, len(words) - 4))) if words else None)
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if bags[i] is None or bags[j] is None or label[i] == label[j]:
                continue
            both, either = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if 5 * both >= 4 * either:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    first = {}
    for (doc, _), x in zip(docs, label):
        first[x] = doc if x not in first or first[x] is None else first[x] if doc is None else min(first[x], doc)
    return [(doc, first[x]) for (doc, _), x in zip(docs, label)]


def damaged(rows):
    """(conv, turn, role, text) rows after the faults."""
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))


def faults(rows):
    """First fault of each of a conversation's ordered rows."""
    out, seen = [], set()
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of one conversation, by trying edits state by state."""
    rows = ordered(rows)
    found = faults(rows)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    # state: the initials' end, "" at the start; values (cost, audit, repaired rows)
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(4):
            for q, (cost, audit, kept) in list(best.items()):
                for (p, x), to in step.items():
                    if p == q and x != "s":
                        value = (cost + 3, audit + "I", kept + [(names[x], "")])
                        if to not in best or value[:2] < best[to][:2]:
                            best[to] = value
        return best

    best = inserted({"": (0, "", [])})
    for (_, _, role, text), fault in zip(rows, found):
        new = {}

        def offer(q, value):
            if q not in new or value[:2] < new[q][:2]:
                new[q] = value

        for q, (cost, audit, kept) in best.items():
            offer(q, (cost + 4, audit + "D", kept))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            if (q, role[:1]) in step and role:
                offer(step[q, role[:1]], (cost + more, audit + "K", kept + [(role, text)]))
            for x in "ua":
                if (q, x) in step:
                    offer(step[q, x], (cost + 3 + more, audit + "R", kept + [(names[x], text)]))
        best = inserted(new)
    cost, audit, kept = min((best[q] for q in ("", "a") if q in best), key=lambda v: v[:2])
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    return (gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, digest)


def cheapest_by_trial(rows):
    """(cost, audit) of a very short conversation: all edits and up to two insertions at every place."""
    rows = ordered(rows)
    found, good, answers = faults(rows), re.compile("(s?(ua)+)?"), []
    adds = ["", "u", "a", "ua", "au"]
    options = []
    for (_, _, role, _), fault in zip(rows, found):
        own = [("D", "", 4)]
        if fault not in ("blank", "duplicate"):
            more = 3 if fault == "truncated" else 0
            own += [("K", role[:1] or "?", more), ("R", "u", 3 + more), ("R", "a", 3 + more)]
        options.append(own)
    for edits in itertools.product(*options):
        for places in itertools.product(adds, repeat=len(rows) + 1):
            roles, audit, cost = places[0], "I" * len(places[0]), 3 * sum(map(len, places))
            for (letter, initial, price), add in zip(edits, places[1:]):
                roles, audit, cost = roles + initial + add, audit + letter + "I" * len(add), cost + price
            if good.fullmatch(roles):
                answers.append((cost, audit))
    return min(answers)


def vector_codes(vectors, parts=16, entries=64, rounds=2):
    """{id: (code, error)} and the digest of the codebooks, for (id, components) rows of one length, by comparing everything."""
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v in sorted(vectors, key=lambda r: r[0])]
    width = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * width: (p + 1) * width]
    books = [[cut(v, p) for _, v in rows[:entries]] for p in range(parts)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        groups = [collections.defaultdict(list) for _ in range(parts)]
        for _, v in rows:
            for p in range(parts):
                groups[p][near(v, p)[1]].append(cut(v, p))
        for p in range(parts):
            for k, members in groups[p].items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    out = {}
    for i, v in rows:
        found = [near(v, p) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
