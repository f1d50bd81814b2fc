"""Plain one-machine versions of what the operators compute."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from matchloom.llm.near_duplicates import shingles, similarity, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
SECRETS = {"assign": r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
           "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def luhn(digits):
    twice = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
    return sum(twice) % 10 == 0


def pii(text):
    def good(kind, value):
        digits = re.sub("[^0-9]", "", value)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]

    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if good(k, m[0])] for k, p in PII.items()}


def secrets(text):
    least = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if least[k](m)] for k, p in SECRETS.items()}


def removed(texts, length=400):
    """For each text, which bytes lie under a repeated string."""
    raws = [(t or "").encode() for t in texts]
    met = Counter(hashlib.md5(r[i:i + length]).digest() for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if met[hashlib.md5(r[i:i + length]).digest()] > 1:
                gone[i:i + length] = True
        out.append(gone)
    return out


def near_classes(texts, least=0.8):
    """Smallest key of each key's class, over all pairs that share a shingle."""
    each = {k: shingles(words(t or ""), 5) for k, t in texts.items()}
    where = defaultdict(set)
    for k, s in each.items():
        for x in s:
            where[x].add(k)
    pairs = {(a, b) for ks in where.values() for a in ks for b in ks if a < b}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in pairs:
        common = len(set(each[a]) & set(each[b]))
        if common >= 0.5 * len(set(each[a]) | set(each[b])) and similarity(each[a], each[b], least) >= least:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {k: find(k) for k in texts}


def hit_words(text, items, size=10):
    """Number of words inside windows, and the items met."""
    w = WORD.findall(lower(text))
    covered, met = set(), set()
    for name, item in items.items():
        iw = WORD.findall(lower(item))
        n = min(size, len(iw))
        windows = {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i:i + n]) in windows:
                covered |= set(range(i, i + n))
                met.add(str(name))
    return len(w), len(covered), sorted(met)


def boilerplate(rows, sites=8, chars=1):
    """Texts by id without all but the first copy of lines from many sites; ``rows`` are (id, text, site)."""
    spread = defaultdict(set)
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            if len(line.strip(" ")) >= chars and site is not None:
                spread[line.strip(" ")].add(site)
    gone = {line for line, s in spread.items() if len(s) >= sites}
    out, seen = {}, set()
    for key, text, _ in sorted(rows):
        kept = []
        for line in (text or "").split("\n"):
            bare = line.strip(" ")
            if bare in gone and bare in seen:
                continue
            seen.add(bare)
            kept.append(line)
        out[key] = "\n".join(kept)
    return out


def token_ids(file, text, end):
    if file not in _LIBRARY:
        _LIBRARY[file] = Tokenizer.from_file(public_tokenizers.path(file))
    return _LIBRARY[file].encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


_LIBRARY: dict = {}


def language_rows(rows, config, buckets=1 << 16):
    """(language, posterior, accepted) of each (text, tag, address): likelihood, priors and fusion, term by term.

    For tables of which every row is in the sample.
    """
    def grams(text):
        raw = (" " + text.lower() + " ").encode()
        return [(((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761) & 0xFFFFFFFF) >> 16 for i in range(len(raw) - 2)]

    def host_of(url):
        rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url or "").lower()
        return re.match(r"(?:[^/?#]*@)?([^/?#:]*)", rest)[1]

    full = [bool(t and t.strip()) for t, _, _ in rows]
    tags = [m[0].lower() if (m := re.match("[A-Za-z]{2,3}(?![A-Za-z])", (g or "").strip())) else "" for _, g, _ in rows]
    seen = Counter(g for g, f in zip(tags, full) if g and f)
    names = sorted(g for g, n in seen.items() if n >= config.least_rows)
    tables = {g: Counter() for g in names}
    for text, tag in {(t, g) for (t, _, _), g, f in zip(rows, tags, full) if f and g in tables}:
        size = len((" " + text.lower() + " ").encode())
        for b in grams(text):
            tables[tag][b] += min(1.0, 2000 / size)
    unknown = -np.log(buckets) * (0.5 + config.floor / 2)

    def text_score(text):
        found = grams(text)
        n = min(config.weight, len(found))
        score = []
        for g in names:
            total = sum(tables[g].values()) + 0.05 * buckets
            score.append(sum(np.log((tables[g][b] + 0.05) / total) for b in found) / len(found) * n)
        return np.array([*score, unknown * n])

    scores = [text_score(t) if f else None for (t, _, _), f in zip(rows, full)]
    k = len(names)
    best = [int(s.argmax()) if s is not None else k for s in scores]
    hosts = [host_of(a) for _, _, a in rows]
    suffix = lambda h: h.rpartition(".")[2] if "." in h else ""

    def shares(which, above, strength):
        counts = np.bincount([b for b, w in zip(best, which) if w], minlength=k + 1)
        return (above * strength + counts) / (strength + counts.sum())

    top = (np.bincount(best, minlength=k + 1) + 1) / (len(rows) + k + 1)
    prior = {}
    for h in set(hosts):
        wide = shares([suffix(x) == suffix(h) for x in hosts], top, config.suffix)
        prior[h] = shares([x == h for x in hosts], wide, config.host)
    out = []
    for score, tag, host in zip(scores, tags, hosts):
        if score is None or not k:
            out.append(("und", None, False))
            continue
        chance = np.exp(score - score.max()) * prior[host]
        chance[k] *= config.unknown
        if tag in names:
            told = np.full(k + 1, (1 - config.declared) / max(1, k - 1))
            told[names.index(tag)], told[k] = config.declared, (1.0 if k == 1 else 1 / k)
            if k == 1:
                told[0] = config.declared
            chance = chance * told
        chance = chance / chance.sum()
        at = int(chance.argmax())
        out.append((names[at] if at < k else "und", float(chance[at]), at < k and chance[at] >= config.keep))
    return out
