"""Plain versions of the operators, for small inputs."""

import hashlib
import re


def suffix_digests(rows, width=100):
    """rows: (doc_id, text), distinct; by doc_id, null first."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - width + 1):
            window = data[s : s + width]
            if window in seen:
                gone[s : s + width] = b"\1" * width
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def similar_groups(rows):
    """rows: (doc_id, text), doc_id not null and unique. All pairs that share a shingle are compared."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    compared = set()
    for same in holders.values():
        for i, a in enumerate(same):
            for b in same[i + 1 :]:
                if (a, b) not in compared:
                    compared.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                        x, y = root(a), root(b)
                        parent[max(x, y)] = min(x, y)
    return sorted((d, len(s), root(d)) for d, s in sets.items())


def quality(rows, limit, least_percent):
    """rows: (doc_id, text, source). The verdict, with the rules spelled out."""
    def lines(text):
        plain = [re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), x))).strip(" ") for x in (text or "").split("\n")]
        return [x for x in plain if x]

    holders = {}
    for _, text, source in rows:
        own = lines(text)
        for x in own:
            holders.setdefault((source, x), set()).add(tuple(own))
    out = []
    for doc_id, text, source in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 5)}
        raw = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        removed = sum(len(x.split(" ")) for x in lines(text) if len(holders[source, x]) > limit)
        kept = not failed and 100 * (len(words) - removed) >= least_percent * len(words)
        symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
        out.append((doc_id, len(words), sum(map(len, words)), symbols, len(raw) - len(set(raw)), len(covered), failed, removed, kept))
    return out


def main_text(article):
    import html

    spaced = re.sub(r"</?(?:p|h1|br)[^>]*>", " ", article)
    return " ".join(html.unescape(re.sub(r"<[^>]+>", "", spaced)).split())
