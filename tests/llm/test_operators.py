"""Each operator against a brute-force version on small tables."""

import hashlib
import io
import random
import re
import struct
import zipfile
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import islice

import pytest
from pyspark.sql import functions as F

from quillmill.llm import decontam, graph, licenses, lines, minhash, mixing, quality, repeats, rules, store, urlfilter, warc
from tests.llm.helpers import SCHEMA, documents, edited, frame, prose, words


def rows_of(df, key="doc_id"):
    out = defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r)
    return out


# quality rules


def base_counts(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    hit = {p for i in range(len(ws) - 7) if seen[tuple(ws[i : i + 8])] > 1 for p in range(i, i + 8)}
    filled = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(filled) - len(set(filled)), len(hit)


def test_quality_rules(spark):
    common = "this line is on every page of the host today"
    rows = documents() + [(400 + k, common + "\n" + prose(400 + k), "s9") for k in range(6)] + [(450, common + "\n" + common + " x", "s9"), (451, common * 3, "s9")]
    rows += [(460 + k, f"{common}\nshort tail {k}" + " w" * 18, "s9") for k in range(2)]
    settings = rules.Settings(host_docs=5, left_words=25)
    got = rows_of(rules.judge(frame(spark, rows), settings))
    assert sum(map(len, got.values())) == len(rows)
    for doc_id, text, source in rows:
        want = base_counts(text)
        r = next(x for x in got[doc_id] if x["n_words"] == want[0])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert got[400][0]["kept"] and got[400][0]["lost_words"] == 10 and not got[460][0]["kept"]
    kept = rows_of(rules.filtered(frame(spark, rows), settings))
    assert common not in kept[400][0]["text"].split("\n") and kept[400][0]["text"] == prose(400)
    assert 460 not in kept and kept[7][0]["text"] == prose(7) and kept[7][0]["label"] == "label"
    # a filter on the result is not worse than the result
    assert rules.judge(frame(spark, rows), settings).where("kept").count() == sum(len(v) for v in kept.values())


def test_line_limits_are_shares_of_the_host(spark):
    """The footer of a small host goes; in a large one a line of as many documents stays."""
    footer, motto = "the same footer stands below every page", "now and then somebody says this line"
    rows = [(k, f"{prose(k)}\n{footer}", "small") for k in range(60)]
    rows += [(1000 + k, prose(1000 + k) + (f"\n{motto}" if k % 30 == 0 else ""), "large") for k in range(600)]
    rows += [(5000 + k, f"{prose(7)}\n{motto}", "copies") for k in range(40)]  # one text, however often
    got = rows_of(rules.judge(frame(spark, rows, False)))
    assert all(got[k][0]["lost_words"] == 7 and got[k][0]["kept"] for k in range(60))
    assert all(r[0]["lost_words"] == 0 for k, r in got.items() if k >= 1000)
    kept = rows_of(rules.filtered(frame(spark, rows, False)))
    assert all(kept[k][0]["text"] == prose(k) for k in range(60)) and motto in kept[1000][0]["text"]


# licences


def test_license_scan(spark):
    mit = "Copyright (c) 2019 A. Person\n\n" + licenses.TEXTS["MIT"].upper().replace("SUBLICENSE", "sub-license").replace(",", " ;")
    rows = [(1, mit, "a"), (2, licenses.TEXTS["MIT"] + " and more", "a"), (3, "text\nLicensed under the Apache Licence, version 2.0\nmore", "a"), (4, None, "a"), (5, "", None), (1, mit, "a")]
    got = rows_of(licenses.scan(frame(spark, rows), licenses.known_licenses(spark)))
    assert [r["license_id"] for r in got[1]] == ["MIT", "MIT"] and got[2][0]["license_id"] is None
    assert got[3][0]["notices"] == ["Apache-2.0"] and got[4][0]["digest"] is None
    assert got[5][0]["digest"] == hashlib.sha256(b"").hexdigest()
    assert licenses.scan(frame(spark, []), licenses.known_licenses(spark)).count() == 0


def test_license_scan_of_texts_that_the_tables_do_not_hold(spark):
    ids = ["Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "MPL-2.0", "BSD-3-Clause", "CC0-1.0"]
    rows = [(k, (licenses.FOLDER / f"{i}.txt").read_text().upper().replace(";", " ;"), "a") for k, i in enumerate(ids)]
    rows += [(20, (licenses.FOLDER / "Apache-2.0.txt").read_text().split("END OF TERMS")[0], "a")]
    rows += [(21, '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not', "a"), (22, "// SPDX-License-Identifier: MPL-2.0\nint x;", "a")]
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, rows), licenses.known_licenses(spark)).collect()}
    assert [got[k]["license_id"] for k in range(len(ids))] == ids and got[20]["license_id"] == "Apache-2.0"
    assert got[21]["notices"] == ["Apache-2.0"] and got[22]["notices"] == ["MPL-2.0"]


# mixing


@pytest.mark.parametrize("seed", range(12))
def test_pfair_deviation(seed):
    r = random.Random(seed)
    share = mixing.shares({f"s{i}": r.random() ** 4 + 1e-6 for i in range(r.randint(1, 30))}, 200)
    done, slots = Counter(), sum(share.values())
    for t, k in enumerate(mixing.period(share), 1):
        done[k] += 1
        assert all(abs(done[x] - t * share[x] / slots) < 1 for x in share)
    assert done == share


def test_mixing(spark):
    rows = documents()
    got = mixing.mix(frame(spark, rows), {"s0": 5, "s1": 3, "s2": 1, "": 1}, mixing.Settings(block_rows=2, slots=20, bucket_rows=5)).collect()
    first = [r for r in got if r["epoch"] == 0]
    assert Counter(r["doc_id"] for r in first) == Counter(d for d, _, _ in rows)
    assert len({(r["slot"], r["place"]) for r in got}) == len(got)
    by_slot = {}
    for r in got:
        assert by_slot.setdefault(r["slot"], r["source"] or "") == (r["source"] or "")
    weight = {"s0": 0.5, "s1": 0.3, "s2": 0.1, "": 0.1}
    done = Counter()
    for t in range(max(by_slot) + 1):
        done[by_slot[t]] += 1
        assert all(abs(done[k] - (t + 1) * w) < 1 for k, w in weight.items())
    assert mixing.mix(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(frame(spark, rows), {"s0": 1})


def test_schedule_keeps_the_exact_weights():
    weights = {f"s{i}": (i + 1) ** 0.7 for i in range(20)} | {"rare": 1e-5, "hot": 40.0}
    exact, done = mixing.whole(weights), Counter()
    total = sum(exact.values())
    assert all(Fraction(w) * total == exact[k] * sum(map(Fraction, weights.values())) for k, w in weights.items())
    for t, (k, j) in enumerate(islice(mixing.schedule(exact), 30_000), 1):
        assert j == done[k]
        done[k] += 1
        assert all(abs(done[x] * total - t * exact[x]) < total for x in exact)


def test_mixing_keeps_the_target_over_many_periods(spark):
    rows = [(k, None, "a" if k % 3 else "b") for k in range(3000)] + [(5000, None, "c")]
    weights = {"a": 0.61237, "b": 0.38743, "c": 0.0002}
    got = mixing.mix(frame(spark, rows, False), weights, mixing.Settings(block_rows=1, slots=10)).select("slot", "source", "epoch", "doc_id").collect()
    assert {r["doc_id"] for r in got if r["epoch"] == 0} == {k for k, _, _ in rows}
    exact, done = mixing.whole(weights), Counter()
    total = sum(exact.values())
    for t, r in enumerate(sorted(got), 1):
        done[r["source"]] += 1
        assert r["slot"] == t - 1 and all(abs(done[k] * total - t * w) < total for k, w in exact.items())


def test_mixing_of_more_than_a_thousand_sources(spark):
    rows = [(k, None, f"s{k % 1100}") for k in range(1500)]
    got = mixing.mix(frame(spark, rows, False)).where("epoch = 0").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1500))


# archives


def test_archives(spark, tmp_path):
    big = "<p>payload é</p>" * 20
    rows = [(9, "http://a/9", big), (3, "http://a/3 x\r\n", big), (5, None, None), (6, "u", None), (7, "u", "x" * 99), (8, "u", "x" * 99), (3, "http://a/3", big), (None, "u", "y" * 200), (11, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    settings = warc.Settings(archive_bytes=900, span_bytes=400)
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w", settings)
    got = warc.read_archives(manifest, settings).collect()
    assert Counter(r["page_id"] for r in got) == Counter(r[0] for r in rows) and manifest.count() > 1
    for r in got:
        html = next(h for p, _, h in rows if p == r["page_id"])
        raw = (html or "").encode()
        revisit = raw == big.encode() and r["page_id"] != 3
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if revisit else ("response", None))
        assert revisit or bytes(r["payload"]) == raw


def plain_warc(n):
    body = [f"HTTP/1.1 200 OK\r\n\r\npage {k}".encode() * 1 for k in range(n)]
    digest = [hashlib.sha256(b.split(b"\r\n\r\n", 1)[1]).hexdigest() for b in body]
    return [f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nWARC-Payload-Digest: sha256:{d}\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n" for k, (b, d) in enumerate(zip(body, digest))]


def test_archives_that_others_wrote(spark, tmp_path):
    """Several members, plain and gzipped, with a CDX index, a CDXJ one, one with a gap, and none."""
    import gzip
    import json

    rows = plain_warc(40)
    one, two, three, four = rows[:10], rows[10:20], rows[20:30], [gzip.compress(x) for x in rows[30:]]
    at = lambda xs: [(sum(map(len, xs[:k])), len(xs[k])) for k in range(len(xs))]
    cdx = " CDX N b a m s k r M S V g\n" + "".join(f"key 2024 http://a text/html 200 X - - {n} {o} one.warc\n" for o, n in at(one))
    cdxj = "".join(f"key 2024 {json.dumps({'offset': o, 'length': n, 'filename': f})}\n" for f, xs in (("two.warc", two), ("three.warc", three[1:])) for o, n in at(xs))
    path = tmp_path / "others.wacz"
    with zipfile.ZipFile(path, "w") as z:
        for name, data in {"one.warc": one, "two.warc": two, "three.warc": three, "four.warc.gz": four}.items():
            z.writestr(f"archive/{name}", b"".join(data))
        z.writestr("indexes/a.cdx", cdx)
        z.writestr("indexes/b.cdxj.gz", gzip.compress(cdxj.encode()))
    runs = list(warc.spans(str(path), 400))
    assert len(runs) > 6 and sum(n for _, n in runs) == sum(len(x) for x in one + two + three + four)
    got = warc.read_archives(spark.createDataFrame([(str(path),)], "path string"), warc.Settings(span_bytes=400)).collect()
    assert sorted(r["page_id"] for r in got) == list(range(40)) and all(bytes(r["payload"]) == f"page {r['page_id']}".encode() for r in got)
    none = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/none")
    assert none.count() == 0 and warc.read_archives(none).count() == 0


def test_zip64_directory():
    data = b"WARC data " * 50
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        with z.open("archive/data.warc", "w", force_zip64=True) as f:
            f.write(data)
        z.writestr("other.txt", "x", zipfile.ZIP_DEFLATED)
    plain = out.getvalue()
    end = plain.rfind(warc.END)
    count, length, offset = struct.unpack("<8xHHII2x", plain[end : end + 22])[1:]
    # the same archive, with the counts only in the ZIP64 records
    wide = struct.pack("<4sQHHIIQQQQ", warc.END64, 44, 45, 45, 0, 0, count, count, length, offset)
    locator = struct.pack("<4sIQI", warc.LOCATOR64, 0, end, 1)
    closed = struct.pack("<4sHHHHIIH", warc.END, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    for raw in (plain, plain[:end] + wide + locator + closed):
        import pyarrow as pa

        found = warc.members(pa.BufferReader(raw), len(raw))
        m = next(m for m in found if m["name"] == "archive/data.warc")
        assert len(found) == 2 and m["method"] == 0 and raw[m["offset"] : m["offset"] + m["size"]] == data
    with pytest.raises(ValueError):
        warc.members(pa.BufferReader(b"no archive"), 10)


# long repeats


def brute_repeats(texts, n):
    where = Counter(b[i : i + n] for b in texts for i in range(len(b) - n + 1))
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if where[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        left = bytes(x for x, g in zip(b, gone) if not g)
        yield len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest()


def test_long_repeats(spark):
    r = random.Random(3)
    passage = prose(900, 40)
    rows = documents() + [(500 + k, prose(600 + k)[: r.randint(0, 300)] + passage[r.randint(0, 60) : len(passage) - r.randint(0, 60)] + prose(700 + k)[: r.randint(0, 300)], "s0") for k in range(12)]
    rows += [(600, "ab" * 300, "s0"), (601, "xyz " + "ab" * 90, "s0"), (602, "é" * 100 + prose(5)[:200], "s0")]
    got = rows_of(repeats.remove_repeats(frame(spark, rows), repeats.Settings(length=100, gram=24), keep_text=True))
    want = list(brute_repeats([(t or "").encode() for _, t, _ in rows], 100))
    for (doc_id, _, _), w in zip(rows, want):
        assert w in [(x["n_bytes"], x["n_removed"], len(x["runs"]), x["kept_sha256"]) for x in got[doc_id]], doc_id
    assert sum(len(v) for v in got.values()) == len(rows)
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("levels", [10, 11, 12])
def test_strings_that_powers_of_two_take_for_equal(spark, levels):
    """Strings of Thue and Morse share every polynomial hash modulo 2**64."""
    a, b = "a", "b"
    for _ in range(levels):
        a, b = a + b, b + a
    head = " ".join(f"w{k}" for k in range(40))
    rows = [(1, f"{head} {a}", "s"), (2, f"{head} {b}", "s")]
    n = len(a)
    import numpy as np

    from quillmill.llm import arrays

    sums = arrays.prefix(np.frombuffer((a + b).encode(), np.uint8))
    x, y = arrays.substring_hash(sums, np.array([0, n]), np.array([n, 2 * n])).tolist()
    assert x != y
    if levels == 10:
        got = rows_of(repeats.remove_repeats(frame(spark, [(1, a, "s"), (2, b, "s")], False), repeats.Settings(length=1000, gram=100)))
        assert [got[d][0]["n_removed"] for d in (1, 2)] == [0, 0]
        sets = rows_of(minhash.near_duplicates(frame(spark, rows, False), minhash.Settings(percent=100)))
        assert sets[1][0]["kept"] and sets[2][0]["kept"]


# URL filters


def test_url_filter(spark):
    rules_ = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.example.net", "/en/x", "block"), ("", "/", "block"), ("dup.org", "/", "allow"), ("dup.org", "/", "block")]
    hosts = ["net", "a.net", "notnet", "Example.NET", "www.example.net", "a.example.net", "b.a.example.net", "example.com", "xexample.com", "w.example.com:80", "dup.org", "q.dup.org", "", "net.", "a..net"]
    paths = ["", "/", "/en", "/en/", "/en/x/y", "/de/1?x=/en/", "/fr/#top", "?q", "#f"]
    urls = [f"{s}{h}{p}" for s in ("http://", "x://") for h in hosts for p in paths] + [None, "no scheme", "http://", "a://b://c.net/en/"]
    pages = [(k, u) for k, u in enumerate(urls)] + [(None, "http://a.net/"), (1, urls[1])]

    def brute(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules_ if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return (host, path, best[3] if best else None, best[2] if best else "allow")

    got = urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules_, "host string, path string, verdict string")).collect()
    assert len(got) == len(pages)
    for r in got:
        url = next(u for p, u in pages if p == r["page_id"])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(url), url


# near duplicates


@pytest.mark.parametrize("percent", [80, 85])
def test_minhash(spark, percent):
    rows = [r for r in documents() if r[0] is not None] + [(700 + k, edited(prose(701, 300), k, k % 9), "s0") for k in range(40)]
    sets = defaultdict(set)
    for d, t, _ in rows:
        w = [x.lower() for x in words(t)]
        sets[d] |= {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    group = {d: d for d in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    got = rows_of(minhash.near_duplicates(frame(spark, rows), minhash.Settings(percent=percent)))
    assert {d: (len(sets[d]), root(d)) for d in sets} == {d: (r[0]["n_shingles"], r[0]["component_id"]) for d, r in got.items()}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for rs in got.values() for r in rs)
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_close_pairs_of_a_clump_are_few_and_none_is_left_out(spark, percent):
    r, common = random.Random(5), list(range(140))
    # 150 sets of which 70 % are common to all, and a group of near copies with strays around it
    rows = [(k, k, common + [1000 * (k + 1) + i for i in range(60)]) for k in range(150)]
    base = [10**6 + i for i in range(100)]
    rows += [(200 + k, 200, r.sample(base, 96) + [10**7 + 100 * k + i for i in range(4)]) for k in range(60)]
    rows += [(300 + k, 300 + k, r.sample(base, 70 + k) + [10**8 + 100 * k + i for i in range(r.randrange(12))]) for k in range(30)]
    sets = {k: (label, set(s)) for k, label, s in rows}
    want = set()
    for a in sets:
        for b in sets:
            (la, x), (lb, y) = sets[a], sets[b]
            if a < b and la != lb and 100 * len(x & y) >= percent * len(x | y):
                want.add((a, b))
    df = spark.createDataFrame([(k, label, k, s) for k, label, s in rows], "id long, label long, set long, shingles array<long>")
    got = [(p["a"], p["b"]) for p in minhash.close_pairs(df, percent).collect()]
    assert want and want <= set(got) and len(got) == len(set(got))
    assert not [p for p in got if p[1] < 200]  # of 11,175 pairs that share much, none may reach it


# decontamination


def test_decontamination(spark):
    item = [prose(800 + k, 14 + k).replace("\n", " ") for k in range(4)]
    bench = [(1, item[0]), (2, item[1]), (3, "tiny item"), (4, None), (5, "!!!"), (6, item[0]), (10, item[0].split(" ", 2)[2])]
    rows = documents() + [(800, "Before, " + item[0].upper() + "! after.", "s0"), (801, prose(5) + " TINY-item " + item[1][:-9], "s0"), (802, "tiny item", "s0"), (803, item[0] + " " + item[0], "s0")]
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    wins = defaultdict(set)
    for i, t in bench:
        w = pattern.findall(low(t))
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[p : p + n])].add(str(i))
    for block in (50_000, 2):
        got = rows_of(decontam.find(frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string"), decontam.Settings(block_items=block)))
        for d, t, _ in rows:
            w = pattern.findall(low(t))
            hit, items = set(), set()
            for n in {len(x) for x in wins}:
                for p in range(len(w) - n + 1):
                    if tuple(w[p : p + n]) in wins:
                        hit |= set(range(p, p + n))
                        items |= wins[tuple(w[p : p + n])]
            r = next(x for x in got[d] if x["n_words"] == len(w))
            assert (sum(s["end"] - s["first"] for s in r["spans"]), list(r["items"])) == (len(hit), sorted(items)), d
    kept = rows_of(decontam.removed(frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string")))
    assert kept[800][0]["text"] == "Before, ! after." and kept[7][0]["text"] == prose(7) and kept[7][0]["items"] == "items"


# line deduplication


def normal_line(line):
    blank = " \t\n\v\f\r"
    words = re.sub(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ", line).lower().strip(" ")
    return words or " ".join(x for x in re.split(f"[{blank}]+", line) if x)


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1]


def alike(x, y):
    """Edit similarity of 80 % or more, without any gate."""
    v, w = x.split(" "), y.split(" ")
    if max(len(v), len(w)) < 8:
        v, w = x, y
    return edits(v, w) <= max(len(v), len(w)) * 20 // 100


def brute_lines(rows):
    """Lines gone for each doc_id: all but the first of a group that plain comparison finds."""
    occ = {(d, p): normal_line(x) for d, t, _ in rows for p, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\v\f\r")}
    texts = sorted(set(occ.values()))
    group = {n: n for n in texts}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if root(a) != root(b) and abs(len(a) - len(b)) < 60 and alike(a, b):
                group[root(a)] = root(b)
    first, gone = {}, Counter()
    for k in sorted(occ):
        if first.setdefault(root(occ[k]), k) != k:
            gone[k[0]] += 1
    return dict(gone)


def test_line_dedup(spark):
    rows = [(k, prose(k, 160).replace("\n", " "), "s0") for k in range(20)] + [(100, prose(3, 160).replace("\n", " ").upper() + "!", "s1")]
    rows = [(d, "\n".join(" ".join(t.split(" ")[k : k + 20]) for k in range(0, 160, 20)), s) for d, t, s in rows]
    rows += [(200 + k, "\n".join(edited(x, 31 * k + i, 1 + k % 2) for i, x in enumerate(rows[k][1].split("\n"))), "s2") for k in range(8)]
    rows += [(300, None, "s0"), (301, "", None), (302, " \n\t\n", "s0"), (303, "one two", "s1"), (304, "x " * 3000, None), (305, "X " * 3000, None)]
    rows += [(900 + k, f"{prose(500 + k, 3)}\nThe, same   LINE of five words\n{prose(5, 12)} tail", "s0") for k in range(3)]
    got = rows_of(lines.deduplicated(frame(spark, rows)))
    assert {d: r[0]["n_gone"] for d, r in got.items() if r[0]["n_gone"]} == brute_lines(rows)
    assert all(r[0]["n_lines"] == len(t.split("\n")) for d, t, _ in rows if t is not None for r in [got[d]])
    assert got[300][0]["text"] is None and got[302][0]["text"] == " \n\t\n" and got[7][0]["label"] == "label"
    empty = lines.deduplicated(frame(spark, []))
    assert empty.count() == 0 and {"n_lines", "n_gone"} <= set(empty.columns)
    # a doc_id that is null comes first, and its line stays
    two = lines.deduplicated(frame(spark, [(None, "a line that comes twice", None), (1, "A line, that comes twice", "s")])).select("doc_id", "n_gone").collect()
    assert {r["doc_id"]: r["n_gone"] for r in two} == {None: 0, 1: 1}


def test_line_dedup_finds_nine_of_ten_edited_lines(spark):
    """Real lines, edited at random and not chosen by any hash. What a line's keys are doesn't
    depend on how many there are, so the share is that of a table of any size."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").where("text is not null").collect()]
    known = sorted({normal_line(x) for t in texts for x in t.split("\n") if len(x.split()) >= 5})
    r = random.Random(11)
    picked = r.sample(known, min(600, len(known)))
    rows, pairs = [], Counter()
    kinds = ["character", "word", "added", "two words"]
    for k, x in enumerate(picked):
        kind, w = kinds[k % 4], x.split(" ")
        if kind == "character":
            at = r.randrange(len(x))
            y = x[:at] + r.choice("abcdefgh") + x[at + 1 :]
        else:
            for _ in range({"word": 1, "two words": 2}.get(kind, 0)):
                w[r.randrange(len(w))] = r.choice(r.choice(known).split(" "))
            if kind == "added":
                w.insert(r.randrange(len(w) + 1), r.choice(r.choice(known).split(" ")))
            y = " ".join(w)
        if normal_line(y) != x and alike(x, normal_line(y)):
            rows += [(2 * k, x, kind), (2 * k + 1, y, kind)]
            pairs[kind] += 1
    got = rows_of(lines.deduplicated(frame(spark, rows, False)))
    found = Counter()
    for d, _, kind in rows:
        found[kind] += got[d][0]["n_gone"] if d % 2 else 0
    assert all(pairs[k] > 80 and found[k] >= 0.9 * pairs[k] for k in kinds), (found, pairs)


def test_keys_of_a_line_do_not_depend_on_other_lines(spark):
    some = [(k, f"{'word' * (k % 3)} line {k} of {k % 7} with a few words {k % 11}") for k in range(40)]
    keys = lambda rows: {tuple(r) for r in lines.block_keys(spark.createDataFrame(rows, "h long, line string"), lines.Settings()).collect()}
    few, many = keys(some), keys(some + [(1000 + k, f"other words of line {k} that come often") for k in range(5000)])
    assert few == {x for x in many if x[0] < 1000} and len(few) > 200


def test_one_changed_word_of_a_short_line_is_met_for_certain(spark):
    r = random.Random(5)
    rows = []
    for k in range(300):
        w = [f"w{r.randint(0, 10**9)}" for _ in range(r.randint(5, 14))]
        at, kind = r.randrange(len(w)), k % 3
        other = w[:at] + ([f"v{k}"] if kind == 0 else [w[at], f"v{k}"] if kind == 1 else []) + w[at + 1 :]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    found = lines.block_keys(spark.createDataFrame(rows, "h long, line string"), lines.Settings()).collect()
    by = defaultdict(set)
    for h, key in found:
        by[h].add(key)
    assert all(by[2 * k] & by[2 * k + 1] for k in range(300))


def test_lines_that_reach_the_similarity_share_a_key_and_pass_the_sketch(spark):
    """Short and frequent words, edits up to the limit, in words and in characters."""
    r, s = random.Random(3), lines.Settings()
    known = "a of the it on in to is page total word number information x1 漢".split()

    def changed(x, k, new):
        for _ in range(k):
            kind, at = r.randrange(3), r.randrange(len(x) + 1)
            x = x[:at] + [r.choice(new)] * (kind < 2) + x[at + (kind > 0) :]
        return x

    rows = []
    for k in range(1500):
        x = [r.choice(known) for _ in range(r.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 33, 70, 130]))]
        line = " ".join(x)
        if len(x) < 9 and k % 2:
            other = "".join(changed(list(line), r.randint(1, len(line) // 5 + 1), "abxyz"))
        else:
            other = " ".join(changed(x, r.randint(1, len(x) // 5 + 1), known))
        rows.append((k, normal_line(line), normal_line(other)))
    df = spark.createDataFrame([x for x in rows if x[1] != x[2]], "id long, x string, y string")
    ws = {v: lines.words_of(F.col(v)) for v in "xy"}
    df = df.select("id", *(c for v in "xy" for c in (F.size(ws[v]).alias(f"{v}n"), lines.symbols(ws[v]).alias(f"{v}sym"), F.col(v).alias(f"{v}line"))))
    df = df.where(lines.linked(s)).persist()
    one = {v: df.select(F.col("id").alias("h"), F.col(f"{v}n").alias("n"), F.col(f"{v}sym").alias("sym"), F.col(f"{v}line").alias("line")) for v in "xy"}
    keys = {v: lines.block_keys(one[v].select("h", "line"), s).distinct() for v in "xy"}
    met = {x["h"] for x in keys["x"].join(keys["y"], ["h", "key"]).select("h").distinct().collect()}
    marks = {v: lines.sketches(one[v]) for v in "xy"}
    marks["y"] = marks["y"].withColumnsRenamed({c: f"o_{c}" for c in marks["y"].columns})
    passed = {x["h"] for x in marks["x"].join(marks["y"], F.col("h") == F.col("o_h")).where(lines.may_link(s)).select("h").collect()}
    linked = {x["id"] for x in df.select("id").collect()}
    assert len(linked) > 1000 and met == linked and passed == linked


def test_keys_that_one_line_alone_has_are_not_written(spark, monkeypatch):
    """Some twenty keys a line would be more than the input; of them the votes (six at most) alone
    are written, for a while."""
    r, sizes = random.Random(8), {}

    def counted(df, name, *a, f=store.written, **b):
        out = f(df, name, *a, **b)
        sizes[name] = max(out.count(), sizes.get(name, 0))
        return out

    monkeypatch.setattr(store, "written", counted)
    rows = [(k, "\n".join(" ".join(f"w{r.randint(0, 10**9)}" for _ in range(40)) for _ in range(10)), "s0") for k in range(30)]
    assert not any(x["n_gone"] for x in lines.deduplicated(frame(spark, rows, False)).collect())
    votes = sizes.pop("votes")
    assert sizes["lines"] == 300 and max(sizes.values()) == 300 and votes <= 6 * 300, (votes, sizes)


def test_groups_by_hubs_are_those_of_all_pairs(spark):
    """A hub leaves its bucket once it has met all of it; no other pair goes unmet."""
    r = random.Random(4)
    at = {k: r.randint(0, 900) for k in range(400)}
    rows = sorted({(r.randint(0, 90) if r.random() < 0.7 else 1000 + k // 2, k) for k in range(400) for _ in range(4)})
    near = lambda x, y: abs(at[x] - at[y]) <= 6
    group = {k: k for k in at}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    by = defaultdict(list)
    for key, k in rows:
        by[key].append(k)
    linked = {(x, y) for ids in by.values() for x in ids for y in ids if x < y and near(x, y)}
    for x, y in linked:
        group[max(root(x), root(y))] = min(root(x), root(y))
    want = {k: root(k) for pair in linked for k in pair}
    places = spark.createDataFrame(list(at.items()), "id long, at long")
    met = []

    def verify(pairs):
        x, y = (places.select(F.col("id").alias(k), F.col("at").alias(f"at_{k}")) for k in "ab")
        met.append(store.written(pairs, "met").collect())
        return store.written(pairs.join(x, "a").join(y, "b").where("abs(at_a - at_b) <= 6").select("a", "b"), "links")

    for rounds in (0, 1, 3):
        met.clear()
        open_ = graph.shared_buckets(spark.createDataFrame(rows, "key long, id long"))
        got = graph.by_hubs(open_, verify, lambda open_: verify(graph.stray_pairs(open_.select("key", "id", "label"))), rounds)
        assert {x["node"]: x["component"] for x in got.collect()} == want
        assert all(x["a"] < x["b"] for pairs in met for x in pairs) and len(met) == rounds + 1


def test_line_dedup_of_short_wide_and_long_lines(spark):
    r = random.Random(9)
    long_line = [f"w{r.randint(0, 10**6)}" for _ in range(2500)]
    changed = [f"v{k}" if k % 200 == 7 else w for k, w in enumerate(long_line)]
    wide = "本文書は全ての権利を留保しており無断での複製と配布を固く禁じます詳細は規約を参照"
    rows = [
        (1, f"All rights reserved.\n----\n\nsame\n{wide}\nfirst", "s0"),
        (2, f"ALL rights, reserved\n----\n\n*\n{wide}\n {wide}!\n{wide[:9]}x{wide[10:]}", "s0"),
        (4, "same\n\n \n==\nall rights", "s1"),
        (4, "same\n\n \n==\nall rights", "s1"),
        (5, " ".join(long_line), "s1"),
        (6, " ".join(changed) + "\nend", "s1"),
    ]
    got = {d: [x["text"] for x in v] for d, v in rows_of(lines.deduplicated(frame(spark, rows))).items()}
    assert got == {1: [rows[0][1]], 2: ["\n*"], 4: ["\n \n==\nall rights"] * 2, 5: [rows[4][1]], 6: ["end"]}


def test_line_dedup_runs_no_python(spark):
    df = lines.deduplicated(frame(spark))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# classifier


def test_classifier(spark):
    r = random.Random(1)
    rows = [(k, prose(k) if k % 2 else " | ".join(prose(k).split()) + " $$$", "s0") for k in range(300)] + [(900, None, "s0"), (901, "", "s0"), (None, prose(3), "s0")]
    labels = [(k, k % 2) for k in range(300) if r.random() < 0.7] + [(5000, 1), (7, None), (None, 1)]
    got = quality.classify(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int"), quality.Settings(sample_rows=120)).collect()
    assert len(got) == len(rows)
    held = [x for x in got if x["held_out"] and x["doc_id"] < 300]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) for x in got if x["doc_id"] is not None)
    assert held and all(x["predicted"] == x["doc_id"] % 2 for x in held)
    empty = {x["score"] for x in got if x["doc_id"] in (900, 901)}
    assert len(empty) == 1 and all(0 <= x["score"] <= 1 for x in got)
    none = quality.classify(frame(spark, rows), spark.createDataFrame([], "doc_id long, quality int"))
    assert {x["score"] for x in none.collect()} == {0.5}


# pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "mixing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert 0 < docs.where("true").count() <= before * (3 if name == "mixing" else 1)
    assert SCHEMA
