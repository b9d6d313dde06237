"""Plain Python twins of the corpus operators, for small inputs."""
import re
import zlib

import xxhash


def lower_az(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall("[^\x20\x09-\x0D]+", t or "")


def item_words(t):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_az(t))


def simhash(t, k=3):
    ws = words(lower_az(t))
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i:i + k]).encode(), 42) for i in range(max(1, len(ws) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash_groups(docs, radius=3):
    fp = {d: simhash(t) for d, t in docs.items()}
    ids = sorted(fp)
    return components(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if (fp[a] ^ fp[b]).bit_count() <= radius])


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def line_dedup(docs, edits=2, min_chars=20):
    """{doc_id: (kept text, removed lines, lines)}"""
    place = {}
    for d in sorted(docs):
        for i, line in enumerate((docs[d] or "").split("\n")):
            if line.strip(" "):
                place.setdefault(line, []).append((d, i))
    lines = sorted(place)
    links = [(a, b) for k, a in enumerate(lines) if len(a) >= min_chars for b in lines[k + 1:]
             if len(b) >= min_chars and abs(len(a) - len(b)) <= edits and edit_distance(a, b) <= edits]
    root = components(lines, links)
    first = {}
    for line in lines:
        first[root[line]] = min(first.get(root[line], (1 << 62, 0)), min(place[line]))
    out = {}
    for d, t in docs.items():
        split = (t or "").split("\n")
        real = [i for i, x in enumerate(split) if x.strip(" ")]
        gone = {i for i in real if first[root[split[i]]] != (d, i)}
        out[d] = ("\n".join(x for i, x in enumerate(split) if i not in gone) if gone else t, len(gone), len(real))
    return out


def substring_dedup(docs, k=20):
    first = {}
    for d in sorted(docs):
        ws = words(docs[d])
        for i in range(len(ws) - k + 1):
            first.setdefault(tuple(ws[i:i + k]), (d, i))
    out = {}
    for d, t in docs.items():
        ws = words(t)
        gone = {j for i in range(len(ws) - k + 1) if first[tuple(ws[i:i + k])] != (d, i) for j in range(i, i + k)}
        out[d] = (len(ws), len(gone), " ".join(w for j, w in enumerate(ws) if j not in gone))
    return out


def contamination(docs, items, n=13):
    windows = {}
    for item, t in items:
        ws = item_words(t)
        if ws and item is not None:
            k = min(n, len(ws))
            for i in range(len(ws) - k + 1):
                windows.setdefault(tuple(ws[i:i + k]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for d, t in docs.items():
        ws, hit, found = item_words(t), set(), set()
        for k in sizes:
            for i in range(len(ws) - k + 1):
                if (w := tuple(ws[i:i + k])) in windows:
                    hit |= set(range(i, i + k))
                    found |= windows[w]
        out[d] = (len(ws), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(ws))
    return out


def fold(doc_id, k):
    return zlib.crc32(str(doc_id).encode()) % k
