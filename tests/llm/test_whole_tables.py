"""Queries over whole tables against plain Python that shares no step with them."""

import hashlib
import re
import zlib
from datetime import date, timedelta

import numpy as np
import pytest
import xxhash

from linkloom.llm import common, pii_feistel, queries, token_counts

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def test_op7_on_the_whole_table(spark):
    rows = common.read(spark, MIDDLE, "documents").collect()
    fps = [fingerprint(r.text) for r in rows]
    parent = {r.doc_id: r.doc_id for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                x, y = sorted((find(rows[i].doc_id), find(rows[j].doc_id)))
                parent[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op7_anchor_simhash(spark, MIDDLE).collect()}
    assert got == {r.doc_id: (f"{f:016x}", find(r.doc_id)) for r, f in zip(rows, fps, strict=True)}


def test_op9_on_the_whole_table(spark):
    """Every piece's ids against the tokenizer; little padding, few cuts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: [*hf.encode(r.text or "", add_special_tokens=False).ids, 0] for r in common.read(spark, MIDDLE, "documents").collect()}
    seqs, spans = {}, {}
    for r in queries.op9_differencing_windows(spark, MIDDLE).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.length == len(part) > 0
        assert r.ids_crc32 == zlib.crc32(np.asarray(part, "<u4").tobytes())
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        spans.setdefault(r.doc_id, []).append((r.start, r.length))
    for parts, whole in [*((p, None) for p in seqs.values()), *((spans[d], len(x)) for d, x in ids.items())]:
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at <= 1024 if whole is None else at == whole
    assert len(seqs) * 1024 <= 1.01 * sum(map(len, ids.values())) + 8 * 1024


def test_op2_on_the_whole_table_with_the_real_pieces(spark):
    """The best segmentation of every distinct word, by its own dynamic programme over pieces."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = token_counts.load_pieces(path)
    longest, cache = max(map(len, pieces)), {}

    def count(word):
        t = "▁" + word
        best = [(0.0, 0)] + [None] * len(t)
        for e in range(1, len(t) + 1):
            n = len(t[e - 1].encode())
            options = [(best[e - 1][0] + n * token_counts.UNKNOWN, best[e - 1][1] - n)]
            options += [(best[b][0] + pieces[t[b:e]], best[b][1] - 1) for b in range(max(0, e - longest), e) if t[b:e] in pieces]
            best[e] = max(options)
        return -best[-1][1]

    for r, got in zip(common.read(spark, SMALL, "documents").orderBy("doc_id").collect(), queries.op2_trie_token_counts(spark, SMALL).orderBy("doc_id").collect(), strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        for x in w:
            if x not in cache:
                cache[x] = count(x)
        assert (got.doc_id, got.n_words, got.n_tokens) == (r.doc_id, len(w), sum(cache[x] for x in w))


KEY = "a demonstration key"


def feistel(kind, x, y, nx, ny):
    for r in range(1, 9):
        f = int(hashlib.sha256(f"{KEY}|{kind}|{r}|{nx}|{ny}|{y}".encode()).hexdigest()[:13], 16)
        x, y, nx, ny = y, (x + f) % nx, ny, nx
    return x, y


def digits(kind, d):
    a = len(d) // 2
    x, y = feistel(kind, int(d[:a]), int(d[a:]), 10**a, 10 ** (len(d) - a))
    return f"{x:0{a}d}{y:0{len(d) - a}d}"


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d))))


def refill(m, new):
    it = iter(new)
    return re.sub("[0-9]", lambda _: next(it), m)


def account_sum(a):
    return int("".join(str(int(c, 36)) for c in a[4:] + a[:4])) % 97


def one(m):
    """(kind, pseudonym) of a match; (None, m) if it is not valid."""
    only = re.sub("[^0-9]", "", m)
    if "@" in m:
        return "email", f"user.{hashlib.sha256(f'{KEY}|email|{m.lower()}'.encode()).hexdigest()[:16]}@example.invalid"
    if re.fullmatch("[A-Z]{2}[0-9]{2}[ A-Z0-9]+", m):
        plain = m.replace(" ", "")
        tail = re.sub("[^0-9]", "", plain[4:])
        if len(plain) < 15 or len(tail) < 2 or account_sum(plain) != 1:
            return None, m
        if len(tail) <= 18:
            new = digits("iban", tail)
        else:
            a = len(tail) // 2
            head = digits(f"iban|{tail[a:]}", tail[:a])
            new = head + digits(f"iban|{head}", tail[a:])
        body = refill(m[4:], new)
        return "iban", f"{m[:2]}{98 - account_sum(m[:2] + '00' + body.replace(' ', '')):02d}{body}"
    if ":" in m:
        import ipaddress

        try:
            v = int(ipaddress.IPv6Address(m))
        except ValueError:
            return None, m
        g = [v >> 16 * (7 - i) & 65535 for i in range(8)]
        word = 1 << 32
        out = lambda p: ":".join(f"{x:x}" for h in p for x in divmod(h, 65536))
        high = out(feistel("ipv6:" + ":".join(map(str, g[4:])), g[0] * 65536 + g[1], g[2] * 65536 + g[3], word, word))
        return "ipv6", high + ":" + out(feistel(f"ipv6:{high}", g[4] * 65536 + g[5], g[6] * 65536 + g[7], word, word))
    if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", m):
        a, b, c, d = map(int, m.split("."))
        if max(a, b, c, d) > 255:
            return None, m
        x, y = feistel("ipv4", a * 256 + b, c * 256 + d, 65536, 65536)
        return "ipv4", f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    for form, order, write in ((r"(\d{4})-(\d\d)-(\d\d)", "ymd", "%Y-%m-%d"), (r"(\d\d)\.(\d\d)\.(\d{4})", "dmy", "%d.%m.%Y"), (r"(\d\d)/(\d\d)/(\d{4})", "mdy", "%m/%d/%Y")):
        if x := re.fullmatch(form, m):
            late = order == "mdy" and x[1] > "12"
            part = dict(zip("dmy" if late else order, map(int, x.groups()), strict=True))
            try:
                day = date(part["y"], part["m"], part["d"])
            except ValueError:
                return None, m
            if not 1901 <= day.year <= 2096:
                return None, m
            while True:
                i = (day - date(1901, 1, 1)).days
                a, b = feistel("date", i // 487, i % 487, 147, 487)
                day = date(1901, 1, 1) + timedelta(a * 487 + b)
                if not late or day.day > 12:
                    return "date", day.strftime("%d/%m/%Y" if late else write)
    if re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", m):
        a, b, c = map(int, m.split("-"))
        if a in (0, 666) or a >= 900 or not b or not c:
            return None, m
        x, y = feistel("national", (a - 1 - (a > 666)) * 99 + b - 1, c - 1, 898 * 99, 9999)
        a = x // 99 + 1
        return "national", f"{a + (a >= 666):03d}-{x % 99 + 1:02d}-{y + 1:04d}"
    if re.fullmatch(r"[0-9]{13,16}|[0-9]{4}([ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}", m):
        if luhn(only) % 10:
            return None, m
        new = digits("card", only[:-1])
        return "card", refill(m, new + str(-luhn(new + "0") % 10))
    if m.startswith("+") and not re.match(r"\+1[ .\-(0-9]", m):
        code = re.match("[17]|2[07]|3[0123469]|4[013456789]|5[1-8]|6[0-6]|8[1246]|9[0-58]|...", only)[0]
        if not 4 <= len(only) - len(code) or len(only) > 15:
            return None, m
        return "phone", refill(m, code + digits(f"phone+{code}", only[len(code) :]))
    if re.fullmatch(pii_feistel.PHONE, m):
        return "phone", refill(m, only[:-10] + digits("phone", only[-10:]))
    return "phone", refill(m, only[0] + digits("phone0", only[1:]))


def plain(text):
    n = dict.fromkeys(pii_feistel.KINDS, 0)

    def sub(x):
        kind, new = one(x[0])
        if kind:
            n[kind] += 1
        return new

    return (None if text is None else re.sub(pii_feistel.ANY, sub, text)), n


CASES = [
    "paid by 4111-1111-1111-1111 on 25/12/1980, 25.12.1980, 12/25/1980 and 1980-12-25; not 31.02.1999 or 31/11/1999",
    "+33 1 42 68 53 00, +33142685300, +49 (30) 1234-5678, +351 21 123 4567, 01 42 68 53 00, 0142685300, 030/1234567, 0171 1234567, 612 345 678, 912 34 56 78",
    "GB82 WEST 1234 5698 7654 32 / DE89370400440532013000 / FR1420041010050500013M02606 / FR1420041010050500013M02607 / MT84MALT011000012345MTLCAST001S",
    "2001:db8:85a3::8a2e:370:7334 2001:0db8:85a3:0000:0000:8a2e:0370:7334 fe80::1 12:34:56 std::vector 1:2:3:4:5:6:7:8 1:2:3:4:5:6:7:8:9 ::1",
    "641 234 5678, +1 641 234 5678, (641) 234-5678, 6412345678, 1234567890, 666-12-3456, 123-45-6789, v1.2.3.4 and 10.0.0.300",
    "dates 13/01/1901 31/12/2096 01/01/1900 01.01.2097 29.02.2023 29.02.2024",
]


@pytest.mark.parametrize("cases", [False, True])
def test_op10_against_an_independent_feistel(spark, cases):
    rows = [(i, t) for i, t in enumerate([*CASES, None, ""])] if cases else [(r.doc_id, r.text) for r in common.read(spark, MIDDLE, "documents").collect()]
    got = pii_feistel.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY) if cases else queries.op10_feistel_pseudonyms(spark, MIDDLE)
    got, seen = {r.doc_id: r for r in got.collect()}, 0
    for doc, text in rows:
        want, n = plain(text)
        assert got[doc].text == want and {k: got[doc][f"n_{k}"] for k in n} == n
        seen += sum(n.values())
    assert seen > 30


def test_equal_values_stay_linked_and_others_apart(spark):
    days = [(date(1901, 1, 1) + timedelta(i)).strftime("%d/%m/%Y") for i in range(0, 71589, 13)]
    rows = pii_feistel.pseudonymise(spark.createDataFrame([(i, d) for i, d in enumerate(days + days)], "doc_id long, text string"), "k").orderBy("doc_id").collect()
    new = [r.text for r in rows]
    assert new[: len(days)] == new[len(days) :] and len(set(new)) == len(days)
    assert all((a[:2] > "12") == (b[:2] > "12") for a, b in zip(days + days, new, strict=True))


def test_the_key_may_come_from_a_file(spark, tmp_path):
    (tmp_path / "key").write_text("not to be shown")
    spark.conf.set("spark.linkloom.pseudonym.keyFile", str(tmp_path / "key"))
    try:
        d = queries.op10_feistel_pseudonyms(spark, SMALL)
        assert "not to be shown" not in d._jdf.queryExecution().toString()
        assert {r.doc_id: r.text for r in d.collect()} == {r.doc_id: r.text for r in pii_feistel.pseudonymise(common.read(spark, SMALL, "documents"), "not to be shown").collect()}
    finally:
        spark.conf.unset("spark.linkloom.pseudonym.keyFile")
