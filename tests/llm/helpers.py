"""Plain versions of the operators, for small tables."""

import re
from collections import defaultdict

ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SF = "/root/testdata/sf0.001"


class Union:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x):
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = self.up[y] if y in self.up else y
            x = y
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def shingle_sets(rows):
    """{doc_id: set} of 4-word shingles as the contract has them."""
    out = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
        out[i] = frozenset([tuple(w)]) if 0 < len(w) < 4 else frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3))
    return out


def jaccard_brute(rows, percent=85):
    """{doc_id: (n, component)} by comparing all pairs that share a shingle."""
    sets, group, held = shingle_sets(rows), Union(), defaultdict(list)
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    done = set()
    for ids in held.values():
        for a in ids:
            for b in ids:
                if a < b and (a, b) not in done:
                    done.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        group.join(a, b)
    return {i: (len(s), group.find(i)) for i, s in sets.items()}


def contamination_brute(text, items, size=13):
    """(n_words, n_hit, sorted ids) of a text, word by word."""
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))
    w, hit, names = find(text), set(), set()
    for name, item in items:
        b = find(item)
        for k in range(max(0, len(b) - size) + 1 if b else 0):
            win = b[k : k + size]
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    names.add(str(name))
    return len(w), len(hit), sorted(names)


def check_packing(pieces, rows, tokenizer, end=2, most=4096):
    """The exact round trip: every id of every document in one piece, sequences gapless."""
    import zlib

    import numpy as np

    ids = {i: np.asarray([*tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4") for i, t in rows}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        own = ids[p.doc_id][p.start : p.start + p.length]
        assert len(own) == p.length and zlib.crc32(own.tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))] and sum(p.length for p in own) == len(ids[i])
    padding = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        n = sum(p.length for p in own)
        assert n <= most
        padding += 0 if n & (n - 1) == 0 else most - n
    return padding / sum(map(len, ids.values()))
