"""Plain Python versions of the training-data operators, for small tables."""
import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    at = collections.defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i:i + 8])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(w) < 20 or 100 * len(covered) > 30 * len(w))


KINDS = [("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 6, 2),
         ("access", re.compile("AKIA[A-Z0-9]+"), 20, 0), ("hex", re.compile("[0-9a-f]+"), 24, 0)]


def secrets(text):
    spans = sorted((m.start(), i, m.end()) for i, (_, p, least, g) in enumerate(KINDS)
                   for m in p.finditer(text or "") if len(m.group(g)) >= least)
    return [f"{KINDS[i][0]}:{a}:{b}" for a, i, b in spans]


def shingles(text, k):
    w = words(text, lower=True)
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_components(rows, k, percent=80):
    """{row number: least key reachable} of rows (key, text)."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and both * 100 >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return {i: min((rows[j][0] for j in g if rows[j][0] is not None), default=None) for g in groups.values() for i in g}, groups


def kept_lines(rows, percent=80):
    """{key: numbers of the lines with words that stay} of rows (key, text), keys distinct."""
    seen, out = [], {}
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        out[key] = []
        for i, line in enumerate((text or "").split("\n")):
            s = frozenset(words(line, lower=True))
            if s:
                if not any(100 * len(s & o) >= percent * len(s | o) for o in seen):
                    out[key].append(i)
                seen.append(s)
    return out


def substrings(texts, span=35):
    """[(n_words, n_removed, kept_sha256)] of the texts."""
    all_words = [words(t) for t in texts]
    count = collections.Counter(tuple(w[i:i + span]) for w in all_words for i in range(len(w) - span + 1))
    out = []
    for w in all_words:
        gone = {j for i in range(len(w) - span + 1) if count[tuple(w[i:i + span])] > 1 for j in range(i, i + span)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def lm(rows, mu=100.0):
    """Per row (key, text): held out, tokens, known, N, base score, score with exact pair counts."""
    tokens = [words(t, lower=True) + [b""] for _, t in rows]
    out = [zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in rows]
    c, pair, train = collections.Counter(), collections.Counter(), 0
    for w, held in zip(tokens, out):
        if not held:
            train += 1
            c.update(w)
            pair.update(zip([None] + w, w))
    n, v = sum(c.values()), len(c)
    result = []
    for w, held in zip(tokens, out):
        p = [(c[x] + 1) / (n + v + 1) for x in w]
        score = sum(math.log10((pair[h, x] + mu * q) / ((train if h is None else c[h]) + mu)) for h, x, q in zip([None] + w, w, p))
        result.append((held, len(w), sum(c[x] > 0 for x in w), n, sum(map(math.log10, p)), score))
    return result


def bm25(rows, wanted, hash_of, k=10, most=None):
    """{key: [(score, key)]} for rows (key, text) with distinct keys."""
    tf = {d: collections.Counter(words(t, lower=True)) for d, t in rows}
    length = {d: sum(c.values()) for d, c in tf.items()}
    average = sum(length.values()) / len(rows)
    df = collections.Counter(w for c in tf.values() for w in c)
    idf = {w: math.log(1 + (len(rows) - f + 0.5) / (f + 0.5)) for w, f in df.items()}
    out = {}
    for q in filter(wanted, tf):
        terms = sorted(tf[q], key=lambda w: (-tf[q][w] * idf[w], hash_of(w)))[:most]
        scores = collections.Counter()
        for w in terms:
            for d, c in tf.items():
                if c[w]:
                    scores[d] += idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length[d] / average))
        out[q] = sorted(((s, d) for d, s in scores.items()), key=lambda x: (-round(x[0], 9), x[1]))[:k]
    return out


def conversation_trie(rows, hash_of):
    """Nodes of rows (conv_id, turn, role, text), by depth and conv_id."""
    turns = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            one = (role or "", text or "")
            turns[c].append(((turn is not None, turn or 0), hash_of(*one), one))
    own = {c: [x[2] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    members = collections.defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved, out = collections.Counter(), collections.Counter(), []
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def collocations(rows, least=30, longest=4, best=2000):
    """(lang, rank, phrase, a, l, r, n, score) of rows (text, lang)."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    f, n, out = collections.defaultdict(collections.Counter), collections.Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) >= 2 and a >= least}
        cover = collections.Counter()
        for p, a in found.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    cover[p[i:i + size]] = max(cover[p[i:i + size]], a)
        kept = []
        for p, a in found.items():
            if not (cover[p] and 100 * cover[p] >= 80 * a):
                score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:best], 1)]
    return sorted(out)


def language_scores(rows, bucket_of, buckets, alpha, scale):
    """[(held out, language, score)] of rows (key, text, lang)."""
    def features(text):
        s = " " + "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "") + " "
        return [bucket_of(s[i:i + n]) for n in (1, 2, 3) for i in range(len(s) - n + 1) if s[i:i + n].strip(" ")]

    held = [zlib.crc32(("" if k is None else str(k)).encode()) % 5 == 0 for k, _, _ in rows]
    seen = [features(t) for _, t, _ in rows]
    counts, texts = collections.defaultdict(collections.Counter), collections.Counter()
    for out, grams, (_, t, lang) in zip(held, seen, rows):
        if not out and t is not None and lang is not None:
            counts[lang].update(grams)
            texts[lang] += bool(grams)
    langs = sorted(x for x in texts if texts[x])
    size = {x: sum(counts[x].values()) for x in langs}
    log = {x: {b: round((math.log(counts[x][b] + alpha) - math.log(size[x] + alpha * buckets)) * scale) for g in seen for b in g} for x in langs}
    result = []
    for out, grams in zip(held, seen):
        if not grams or not langs:
            result.append((out, "und", 0.0))
            continue
        s = {x: round(math.log(texts[x] / sum(texts.values())) * scale) + sum(log[x][b] for b in grams) for x in langs}
        top = max(s.values())
        result.append((out, min(x for x in langs if s[x] == top), 1 / sum(math.exp((v - top) / scale) for v in s.values())))
    return result
