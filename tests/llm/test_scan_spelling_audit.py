"""Secret scan, spelling variants and filter audit, against plain loops over small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from quarrylake.llm import filteraudit, secrets, spelling

R = random.Random(3)


def _base62(n):
    out = ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = secrets.BASE62[d] + out
    return out


def _crc_token(prefix, flaw=0):
    body = "".join(R.choice(secrets.BASE62) for _ in range(30))
    return prefix + body + _base62(zlib.crc32(body.encode()) ^ flaw)


def _polymod(values):
    c = 1
    for v in values:
        top, c = c >> 25, (c & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(secrets.GENERATOR):
            c ^= g if top >> i & 1 else 0
    return c


def _bech32(prefix, flaw=False):
    data = [R.randrange(32) for _ in range(52)]
    head = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix]
    c = _polymod(head + data + [0] * 6) ^ 1
    data[3] ^= flaw
    return prefix + "1" + "".join(secrets.BECH32[d] for d in data + [c >> 5 * (5 - i) & 31 for i in range(6)])


def _tokens(flaw):
    yield from (_crc_token(p, flaw) for p in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"))
    yield _bech32("age-secret-key-", bool(flaw)).upper()
    yield _bech32("nsec", bool(flaw))


def _secrets_by_hand(text):
    """Every pattern over the whole text, without a prefilter."""
    found = []
    for k, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m[m.lastindex or 0]) >= rule.least and (rule.holds is None or rule.holds(m[0])):
                found.append((m.start(), k, m.end()))
    return [(secrets.RULES[k].kind, s, e) for s, k, e in sorted(found)]


ATOMS = [
    'token = "', "Password:", "SECRET=", "api_key", "apiKEY='", "a", "f", "0", "é", "😀", "ſecret: abcdefghij", "toKen: 12345678", "AKIA",
    "AKIAABCDEFGHIJKL", "0123456789abcdef" * 2, "deadbeef", " ", "\n", "x", "-", ".", "İ", "passwd", "passwdpassword : aaaa:bbbb", "_", ":", "ghp_", "K",
]


def _secret_texts():
    texts = [None, "", "token", "f" * 31, "f" * 32, "g" + "0" * 33 + "g", "token=1234567", "token=12345678", "tokentoken:abcdefgh" * 3, "token" + " " * 50_000 + "x"]
    texts += ["".join(R.choice(ATOMS) for _ in range(R.randrange(40))) for _ in range(800)]
    texts.append(" ".join("".join(R.choice(ATOMS) for _ in range(40)) for _ in range(2000)))
    for flaw in (0, 1):
        texts += [before + t + after for t in _tokens(flaw) for before in ("", " é", "x", "_", "token=") for after in ("", ".", "z", "_")]
    return texts


def test_secrets_by_hand():
    texts = _secret_texts()
    kinds = Counter()
    for t in texts:
        got = secrets.secret_spans(t)
        assert got == _secrets_by_hand(t), t
        kinds.update(k for k, _, _ in got)
    assert set(kinds) == {r.kind for r in secrets.RULES}


def test_checksums_refuse_a_changed_letter():
    for flaw, n in ((0, 1), (1, 0)):
        for t in _tokens(flaw):
            assert len([s for s in secrets.secret_spans(f"see {t}.") if s[0] not in ("assign", "access", "hex")]) == n, t


def test_secrets_keep_rows_and_columns(spark):
    key = _crc_token("ghp_")
    rows = [(1, f"my token: {key} end", "a", 1), (1, f"my token: {key} end", "a", 1), (None, None, None, None), (2, "", "b", 2), (3, "ok 😀 AKIAABCDEFGHIJKL", "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, secrets int")
    got = secrets.find_secrets(docs)
    assert got.columns == docs.columns
    assert sorted(got.drop("secrets").collect(), key=repr) == sorted(docs.drop("secrets").collect(), key=repr)
    spans = {r["doc_id"]: [tuple(s) for s in r["secrets"]] for r in got.collect()}
    assert spans == {1: [("assign", 3, 10 + len(key)), ("github", 10, 10 + len(key))], None: [], 2: [], 3: [("access", 5, 21)]}
    shown = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(docs).collect()}
    assert shown == {1: "my [assign] end", None: None, 2: "", 3: "ok 😀 [access]"}
    assert secrets.find_secrets(docs.limit(0)).count() == 0


def _hood(w, letters):
    out = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
    return (out | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}) - {w}


@pytest.mark.parametrize("block", [1, 7, 1 << 14])
def test_neighbours_are_all_and_distinct(block, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", block)
    words = ["aabbéa", "ab", "a", "bbbbbb", "éééa", "abababab"]
    got = {w: [] for w in words}
    for rows in spelling.neighbours(words, np.frombuffer("abé".encode("latin-1"), np.uint8)):
        for k, h, at, skip, letter in zip(*rows):
            w = words[k]
            made = w[:at] + (chr(letter) if letter else "") + w[at + skip :]
            assert made == "" or spelling.word_hashes([made])[0] == h
            got[w].append(made)
    assert all(sorted(got[w]) == sorted(_hood(w, "abé")) for w in words)


def _forms_by_hand(counts, factor):
    letters, out = {c for w in counts for c in w}, {}
    for w, n in counts.items():
        near = _hood(w, letters) & set(counts)
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        out[w] = (best if best and counts[best] >= factor * n else None, n, len(near))
    rows = set()
    for w, (form, n, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, k, counts[form] if form else None))
    return rows


@pytest.mark.parametrize("factor", [2, 5])
def test_forms_by_hand(spark, factor):
    rng = random.Random(factor)
    counts = {"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 6))): rng.randrange(1, 4000) for _ in range(400)}
    counts |= {"x" * (k + 1): 3**k for k in range(14)} | {"z" * 3000: 5, "z" * 2999 + "y": 50}  # a long chain; long words
    words = spark.createDataFrame([*counts.items(), (None, 3), ("", 9)], "word string, n long")
    got = [tuple(r) for r in spelling.spelling_forms(words, factor).collect()]
    assert len(got) == len(counts) and set(got) == _forms_by_hand(counts, factor)


def test_neighbours_pass_a_full_filter(spark):
    words = spark.createDataFrame([("abcd", 9), ("abcde", 1), ("abce", 2), ("bcda", 3)] + [(f"{chr(97 + k)}q{chr(97 + k)}w", 1) for k in range(26)], "word string, n long")
    assert {tuple(r) for r in spelling.spelling_forms(words, filter_bits=6).collect()} == _forms_by_hand({r["word"]: r["n"] for r in words.collect()}, 5)


def _words_by_hand(rows, spoil):
    out = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % spoil == 0 else run] += 1
    return out


@pytest.mark.parametrize("held", [1, 300_000])
def test_words_by_hand(spark, held, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", held)
    rng = random.Random(9)
    atoms = ["Café", "CAFÉ", "ÀÉÿ", "naïve", "x", "don't", "ab1cd", "×÷", "Ābc", "日本", "😀", " ", "\n", "-", "hello", "HELLO", "ſet"]
    rows = [(k, "".join(rng.choice(atoms) for _ in range(60))) for k in range(60)] + [(None, "hello Hello"), (7, None), (8, ""), (None, "q" * 5000)]
    rows += rows[:3]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs, 7, 1, 1).collect()}
    want = {w: n for w, n in _words_by_hand(rows, 7).items() if w}
    assert got == want
    assert {r["word"] for r in spelling.word_counts(docs, 7, 4, 6).collect()} == {w for w, n in want.items() if len(w) >= 4 and n >= 6}
    assert spelling.spelling_forms(spelling.word_counts(docs.limit(0))).count() == 0


def _audit_by_hand(docs, labels):
    good, toxic = ({r[0] for r in labels if r[0] is not None and r[k] == 1} for k in (1, 2))
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    judged = []
    for i, t, lang in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": t in first and (i is None or first[t] < i),
        }
        judged.append((lang or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    rows, total = {}, Counter()
    for part in {p for p, *_ in judged}:
        own = [j for j in judged if j[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                gone = [j for j in own if j[1] & set(order[:k])]
                out = [j for j in own if f in j[1] and not j[1] & set(order[:k])]
                total[part, f] += len(out)
                rows[part, order, k + 1] = (
                    len(own) - len(gone) - len(out), len(out), sum(f in j[1] for j in gone), sum(j[1] == {f} for j in own), sum(j[2] for j in out), sum(j[3] for j in out),
                )
    return {(*key, *v, total[key[0], key[1][key[2] - 1]]) for key, v in rows.items()}


def test_audit_by_hand(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)] + ["SHOUT", "a#b", "é é", "x y"]

    def text():
        n = rng.choice([0, 5, 99, 100, 130])
        words = rng.sample(vocabulary, n) if rng.random() < 0.5 else [rng.choice(vocabulary[: rng.choice([60, 400])]) for _ in range(n)]
        return rng.choice([" ", "\n", "\x0b "]).join(w.upper() if rng.random() < 0.02 else w for w in words)

    texts = [text() for _ in range(40)]
    docs = [(k, rng.choice(texts), rng.choice(["en", "de", None, ""])) for k in range(200)]
    docs += [docs[3], docs[3], (5, "other text of one id", "en"), (None, texts[0], "en"), (None, texts[0], "en"), (None, "alone", "fr"), (None, "alone", "fr"), (300, None, "en"), (301, "", "en")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(120)] + [(1, 1, 0), (1, 0, 1), (None, 1, 1)]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, lang string, part string, mask int")
    la = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, digest string")
    cells = filteraudit.filter_cells(d, la)
    assert cells.agg({"n": "sum"}).first()[0] == len(docs)
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = filteraudit.interactions(cells).select(*columns).collect()
    assert len(got) == 5 * 600 - 600 and set(map(tuple, got)) == _audit_by_hand(docs, labels)
    assert filteraudit.interactions(filteraudit.filter_cells(d.limit(0), la)).count() == 0
    two = spark.createDataFrame([("p", 3, 5, None, 1), ("p", 3, 1, 2, 0), ("p", 0, 7, 0, 0)], "part string, mask int, n long, good long, toxic long")
    rows = {(r["filter_order"], r["step"]): tuple(r)[4:] for r in filteraudit.interactions(two, "XY").select("part", "filter_order", "step", "filter", *columns[3:]).collect()}
    assert rows == {("XY", 1): (7, 6, 0, 0, 2, 1, 6), ("XY", 2): (7, 0, 6, 0, 0, 0, 6), ("YX", 1): (7, 6, 0, 0, 2, 1, 6), ("YX", 2): (7, 0, 6, 0, 0, 0, 6)}


def test_a_text_is_told_by_its_bytes():
    a, b = "x" * 1000, "x" * 999 + "y"
    assert filteraudit.text_failures(a.encode()) == filteraudit.text_failures(b.encode()) == 1
    assert hashlib.sha256(a.encode()).digest() != hashlib.sha256(b.encode()).digest()
