"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


def quality_base(text):
    t = text or ""
    w, wins = WORD.findall(t), defaultdict(list)
    for k in range(len(w) - 4):
        wins[tuple(w[k : k + 5])].append(k)
    rep = {p for v in wins.values() if len(v) > 1 for k in v for p in range(k, k + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)


def jump(key, n):
    b, j, k = -1, 0, key & (2**64 - 1)
    while j < n:
        b, k = j, (k * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((k >> 33) + 1)))
    return b


def secrets_base(text):
    t, spans = text or "", []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t, re.I | re.A):
        spans += [(m.start(), 0, m.end(), "assign")] * (len(m[2]) >= 8)
    for m in re.finditer(r"AKIA[A-Z0-9]+", t):
        spans += [(m.start(), 1, m.end(), "access")] * (len(m[0]) >= 16)
    for m in re.finditer(r"[0-9a-f]+", t):
        spans += [(m.start(), 2, m.end(), "hex")] * (len(m[0]) >= 32)
    spans.sort()
    said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
    n = [sum(s[3] == k for s in spans) for k in ("assign", "access", "hex")]
    return (*n, hashlib.sha256(said.encode()).hexdigest(), said)


def secrets_linked(text, scope=200):
    """All spans, base ones and the weak ones beside which what they need stands, as kind:start:end by start."""
    t, parts = text or "", []
    for said in secrets_base(t)[4].split(","):
        if said:
            kind, a, b = said.split(":")
            parts.append((int(a), {"assign": 0, "access": 1, "hex": 2}[kind], int(b), kind, "identity" if kind == "access" else "secret"))
    base, weak = list(parts), []
    for m in re.finditer(r"(?:user(?:name)?|login|account|client_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.@-]+)", t, re.I | re.A):
        weak += [(m.start(), 3, m.end(), "ident", "identity")] * (len(m[1]) >= 3)
    for m in re.finditer(r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/=_.-])", t):
        if not any(b[0] < m.end() and m.start() < b[2] for b in base):
            weak.append((m.start(), 4, m.end(), "opaque", "secret"))
    for m in re.finditer(r"(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x00-\x20\"'<>]+", t):
        weak += [(m.start(), 5, m.end(), "endpoint", "endpoint")] * (len(m[0]) >= 10)
    needs = {"ident": {"secret"}, "opaque": {"identity"}, "endpoint": {"identity", "secret"}}
    for w in weak:
        near = {o[4] for o in base + weak if o[4] != w[4] and o[0] <= w[2] + scope and o[2] >= w[0] - scope}
        if needs[w[3]] <= near:
            parts.append(w)
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k, _ in sorted(parts))


def contamination(docs, items, n=10):
    """docs, items: lists of (id, text)."""
    windows = defaultdict(set)
    for i, t in items:
        w = TOKEN.findall((t or "").translate(LOW))
        k = min(n, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[s : s + k])].add(str(i))
    sizes, out = {len(x) for x in windows}, []
    for d, t in docs:
        w, hit, ids = TOKEN.findall((t or "").translate(LOW)), set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                if found := windows.get(tuple(w[s : s + k])):
                    hit.update(range(s, s + k))
                    ids |= found
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def near_contamination(docs, items, n=10, near=2):
    """(id, words in windows that stand at one offset but for a few words), every offset tried."""
    out = []
    listed = [TOKEN.findall((t or "").translate(LOW)) for _, t in items]
    for d, t in docs:
        w, hit = TOKEN.findall((t or "").translate(LOW)), set()
        for item in listed:
            k = min(n, len(item))
            others = max(0, min(near, k // 2 - 1))
            for shift in range(-len(item) + 1, len(w)):
                equal = [0 <= shift + o < len(w) and w[shift + o] == x for o, x in enumerate(item)]
                for s in range(len(item) - k + 1 if item else 0):
                    if sum(equal[s : s + k]) >= k - others:
                        hit.update(p for p in range(shift + s, shift + s + k) if 0 <= p < len(w))
        out.append((d, len(hit)))
    return out


def spark_xxhash(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), seed=seed).intdigest()
        seed = seed  # the running hash is the next seed
    return seed - 2**64 if seed >= 2**63 else seed


def line_chunks(text, window=2, divisor=4):
    lines = text.split("\n")
    hs = [spark_xxhash(x) for x in lines]
    chunks, start = [], 0
    for i in range(len(lines)):
        if i == len(lines) - 1 or i >= window - 1 and spark_xxhash(*[hs[i - k] for k in range(window)]) % divisor == 0:
            chunks.append(lines[start : i + 1])
            start = i + 1
    return chunks


def line_dedup(docs, min_lines=2):
    first, cut = {}, {}
    none_first = lambda d: (d[0] is not None, d[0] or 0, spark_xxhash(d[1] or ""))
    for d, t in sorted({d for d in docs if d[1] is not None}, key=none_first):
        for k, c in enumerate(line_chunks(t)):
            if len(c) >= min_lines:
                first.setdefault("\n".join(c), (d, t, k))
    for d, t in docs:
        if t is not None:
            chunks = line_chunks(t)
            gone = [k for k, c in enumerate(chunks) if len(c) >= min_lines and first["\n".join(c)] != (d, t, k)]
            cut[d, t] = ("\n".join("\n".join(c) for k, c in enumerate(chunks) if k not in gone) if gone else t, sum(len(chunks[k]) for k in gone), len(gone))
        else:
            cut[d, t] = (None, 0, 0)
    return [(d, *cut[d, t]) for d, t in docs]


def crc(x):
    return zlib.crc32(x.encode())


def jaccard(docs, percent=75):
    """(doc_id, n_shingles, component_id, n_links) of (doc_id, text) rows with distinct ids."""
    sets = []
    for _, t in docs:
        w = (t or "").translate(LOW)
        w = WORD.findall(w)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    holders, root, links = defaultdict(list), list(range(len(docs))), [0] * len(docs)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        both = defaultdict(int)
        for x in s:
            for j in holders[x]:
                both[j] += 1
            holders[x].append(i)
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least[find(i)], links[i]) for i, (d, _) in enumerate(docs)]


def lm(docs, discount=0.75):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): back-off over the two words before."""
    import math
    from collections import Counter

    tokens = [(d, crc(str(d)) % 10 == 0, ["<s> ", "<s> ", *WORD.findall((t or "").translate(LOW)), "</s> "]) for d, t in docs]
    grams = {k: Counter(tuple(ws[i - k + 1 : i + 1]) for _, h, ws in tokens if not h for i in range(2, len(ws))) for k in (1, 2, 3)}
    total, after = Counter(), Counter()
    for k in (2, 3):
        for g, c in grams[k].items():
            total[g[:-1]] += c
            after[g[:-1]] += 1
    n, v = sum(grams[1].values()), len(grams[1])
    base = lambda w: (grams[1][w,] + 0.1) / (n + 0.1 * (v + 1))

    def p(gram):
        h = gram[:-1]
        if not h:
            return base(gram[0])
        if grams[len(gram)][gram]:
            return (grams[len(gram)][gram] - discount) / total[h]
        return p(gram[1:]) * (discount * after[h] / total[h] if total[h] else 1)

    return [
        (d, h, len(ws) - 2, sum(grams[1][w,] > 0 for w in ws[2:]), n, sum(math.log10(base(w)) for w in ws[2:]), sum(math.log10(p(tuple(ws[i - 2 : i + 1]))) for i in range(2, len(ws))))
        for d, h, ws in tokens
    ]
