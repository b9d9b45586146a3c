"""Brute-force versions, round trips and odd inputs of the training-data operators."""

import base64
import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from thalweg.llm import archives, covertree, decontam, gam, lexicon, linededup, packing, queries, secrets, simhash

DATA = "/root/testdata/sf0.001"
LONG = "word " * 30000
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (4, "one two three"), (None, "no id here"), (5, LONG), (6, "One TWO three"), (7, "é Ω token = \"0f8e7d6c5b4a39281706f5e4\"\n"),
    (8, "AKIA" + "Q" * 16 + " x"), (9, "deadbeef" * 3 + "\n" + "deadbeef" * 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").cache()


def spans(text):
    text, out = text or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def check_secrets(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want = [spans(t) for i, t in texts if i == r["doc_id"]][0]
        kinds = Counter(k for *_, k in want)
        line = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert ",".join(s for s in r["spans"].split(",") if not s.startswith("random")) == line


def test_secrets(spark, real):
    rows = [tuple(r) for r in real.collect()]
    check_secrets(secrets.scan(real).collect(), rows)
    check_secrets(secrets.scan(docs_of(spark, ODD)).collect(), ODD)
    assert secrets.scan(docs_of(spark, [])).count() == 0


def test_random_tokens_are_found_and_words_are_not(spark):
    rng = random.Random(3)
    letters = secrets.ALPHABETS["base64"]
    noise = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(40)]
    plain = ["https-is-a-very-long-identifier-name", "CamelCaseClassNameFactoryBuilder", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "internationalization2localization"]
    rows = [(k, f"key {t} end") for k, t in enumerate(noise + plain)]
    found = {r["doc_id"]: r["n_random"] for r in secrets.scan(docs_of(spark, rows)).collect()}
    assert sum(found[k] for k in range(40)) >= 36
    assert not any(found[k] for k in range(40, len(rows)))


def test_random_tokens_in_running_text(spark):
    """Of secrets with a random part the battery finds nine in ten; of words, names, paths and dates it takes none."""
    rng = random.Random(8)
    kinds = {"base64": 32, "base32": 40}
    planted = [(k, "".join(rng.choice(secrets.ALPHABETS[kind]) for _ in range(kinds[kind]))) for k, kind in enumerate(list(kinds) * 60)]
    words = "stream water river value order network segment reach model table".split()
    plain = ["-".join(rng.choice(words) for _ in range(5)) + f"-{rng.randrange(30)}" for _ in range(60)]
    plain += ["".join(w.capitalize() for w in rng.sample(words, 5)) for _ in range(60)] + [f"/{'/'.join(rng.sample(words, 5))}/2024" for _ in range(60)]
    rows = [(k, f"some text {t} more text") for k, t in planted] + [(1000 + k, f"some text {t} more text") for k, t in enumerate(plain)]
    found = {r["doc_id"]: r["n_random"] for r in secrets.scan(docs_of(spark, rows)).collect()}
    assert sum(found[k] for k, _ in planted) >= 0.9 * len(planted)
    assert not any(found[1000 + k] for k in range(len(plain)))


def test_very_many_matches_in_one_text(spark):
    text = "".join(f"{'é' * (k % 3)} deadbeefdeadbeef{k % 10} x" for k in range(3 * secrets.CHUNK + 5))
    check_secrets(secrets.scan(docs_of(spark, [(1, text), (2, "deadbeef" * 2)])).collect(), [(1, text), (2, "deadbeef" * 2)])


def bits_of(text):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(rows):
    """Component of each row by comparing all fingerprints."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return sorted((str(i), f"{f:016x}", str(least.get(find(f)))) for i, f in rows)


def test_simhash(spark, real):
    for rows in ([tuple(r) for r in real.collect()], ODD, []):
        found = simhash.near_duplicates(docs_of(spark, rows)).select("doc_id", simhash.fingerprint_text("fp").alias("f"), "component_id").collect()
        assert sorted((str(r[0]), r[1], str(r[2])) for r in found) == grouped([(i, bits_of(t)) for i, t in rows])


def test_golay_code():
    words = np.random.default_rng(0).integers(0, 1 << 23, 2000)
    keys = simhash.golay_keys(words)
    assert {len(set(k)) for k in keys.tolist()} == {1, 6}
    for a in range(23):
        for b in range(a):
            near = simhash.golay_keys(words[:20] ^ (1 << a) ^ (1 << b))
            assert all(set(x) & set(y) for x, y in zip(keys[:20].tolist(), near.tolist(), strict=True))


def test_links_of_tight_groups_are_whole(spark):
    rng = random.Random(1)
    centre = rng.getrandbits(63)
    fps = {centre}
    for _ in range(400):
        f = centre
        for _ in range(rng.randrange(1, 6)):
            f ^= 1 << rng.randrange(63)
        fps.add(f)
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = [tuple(r) for r in simhash.links(frame).collect()]
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in edges:
        root[find(a)] = find(b)
    got = len({find(f) for f in fps})
    want = len({c for *_, c in grouped([(k, f) for k, f in enumerate(sorted(fps))])})
    assert got == want and len(edges) < 40 * len(fps)


def test_one_of_each(spark):
    text = " ".join(f"w{k}" for k in range(300))
    rows = [(5, text), (3, text), (3, text), (9, text + " more"), (1, "something else here"), (None, "third text of its own")]
    kept = simhash.one_of_each(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, []).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "None"]


def test_line_dedup_equals_sql(spark, real):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = sorted(duck.execute(linededup.ORACLE).fetchall())
    got = sorted(tuple(r) for r in linededup.line_dedup(real).collect())
    assert got == want


def test_line_dedup_cases(spark):
    run = "\n".join(" ".join(f"w{r}{k}" for k in range(20)) for r in range(4))
    rows = [(1, f"head one\n{run}\ntail"), (2, f"{run}\n\nown line"), (3, None), (4, ""), (None, run), (5, "\n".join(run.split("\n")[:2])), (6, LONG + "\n" + LONG)]
    got = {r["doc_id"]: r for r in linededup.line_dedup(docs_of(spark, rows)).collect()}
    assert got[1]["text"] == rows[0][1] and got[1]["n_removed"] == 0
    assert got[2]["text"] == "\nown line" and got[2]["runs"] == "0-3"
    assert got[3]["text"] is None and got[4]["text"] == "" and got[None]["text"] == ""
    assert got[5]["n_removed"] == 0  # forty words are too few
    assert got[6]["runs"] == "1-1"
    assert linededup.line_dedup(docs_of(spark, [])).count() == 0


def test_line_dedup_keeps_columns_of_any_name(spark):
    run = "\n".join(" ".join(f"w{r}{k}" for k in range(20)) for r in range(4))
    names = ["_runs", "_mark", "_id", "_text_mark", "mark", "row", "runs", "n_lines", "w", "r", "a.b"]
    rows = [(1, run, *names), (2, run + "\nend", *names), (2, run + "\nend", *names)]
    frame = spark.createDataFrame(rows, ["doc_id", "text", *names])
    made = linededup.line_dedup(frame)
    got = sorted(tuple(r) for r in made.collect())
    kept = [n for n in names if n not in ("runs", "n_lines")]
    assert made.columns == ["doc_id", "text", *kept, "n_lines", "n_removed", "runs"]
    assert got == [(1, run, *kept, 4, 0, ""), *[(2, "end", *kept, 5, 4, "0-3")] * 2]


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.normal(size=6)]) for k in range(0, 700)]
    rows += [(k, [0.5] * 6) for k in range(700, 900)] + [(901, None), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (950, [float("nan")] * 6), (1000, [0.5] * 6), (None, [1.0] * 6), (1000, [0.5] * 6)]
    frame = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int, score int")
    got = sorted(tuple(r) for r in covertree.search(frame).collect())
    ok = sorted((i, tuple(int(np.floor(256 * x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v))
    want = []
    for q, v in sorted(set(ok)):
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q)[:5]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    assert covertree.search(frame.limit(0)).count() == 0


def test_cover_tree_holds_and_prunes():
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(40, 16)) * 400
    points = np.floor(middles[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)) * 8)
    points[2000:2300] = points[7]
    tree = covertree.CoverTree.grown(points)
    assert sorted(tree.order.tolist()) == list(range(3000)) and (tree.points == points[tree.order]).all()
    for k, parent in enumerate(tree.parent.tolist()):
        rows = tree.points[tree.start[k] : tree.stop[k]]
        assert np.linalg.norm(rows - tree.points[tree.centre[k]], axis=1).max() <= tree.radius[k] + 1e-9
        assert tree.start[k] <= tree.centre[k] < tree.stop[k]
        if parent >= 0:
            assert tree.radius[k] <= tree.radius[parent] / 2 + 1e-9
            assert tree.loose[parent] <= tree.start[k] and tree.stop[k] <= tree.stop[parent]
    ids = np.arange(3000)
    _, again = covertree.CoverTree.unpacked(*tree.packed(ids).values())
    assert (again.points == tree.points).all() and (again.radius == tree.radius).all()
    q = covertree.CoverTree.grown(points[:200])
    got = covertree.Search(ids[:200][q.order], q, 5).run(ids[tree.order], tree)
    assert 0 < got.scored < 0.5 * got.pairs  # clustered data: most pairs are never scored
    for r in range(200):
        i = q.order[r]
        want = sorted((-int(points[i] @ points[j]), j) for j in range(3000) if j != i)[:5]
        assert [(-int(s), w) for s, w in zip(got.best[r], got.who[r], strict=True)] == want


def test_subsequence_and_leaks(spark):
    rng = random.Random(4)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    for _ in range(50):
        a, b = ([rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randrange(30))] for _ in range(2))
        assert decontam.subsequence(a, b) == lcs(a, b)
    items = [(k, " ".join(f"i{k}x{j}" for j in range(20))) for k in range(12)] + [(20, None), (21, ""), (None, "a b c d e f g h"), (22, "short one")]
    words = lambda n: " ".join(f"d{rng.randrange(500)}" for _ in range(n))
    para = " ".join(w for j, w in enumerate(items[3][1].split()) if j % 8)
    rows = [(1, words(200)), (2, f"{words(77)} {items[0][1].upper()}. {words(50)}"), (3, f"{words(30)} {para} {words(31)}"), (4, None), (5, ""), (6, f"{words(9)} {' '.join(items[5][1].split()[:6])}"), (None, items[7][1]), (8, "a short one here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs_of(spark, rows), bench).collect()}
    assert found == {(2, 0), (3, 3), (None, 7), (8, 22)}
    clean = decontam.decontaminate(docs_of(spark, rows), bench)
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == ["1", "4", "5", "6"] and clean.columns == docs_of(spark, []).columns
    assert decontam.leaks(docs_of(spark, rows), bench.limit(0)).count() == 0 and decontam.leaks(docs_of(spark, []), bench).count() == 0


def test_leaks_find_every_verbatim_item(spark, real):
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    want = {(d, i) for d, t in map(tuple, real.collect()) for i, x in items if x in t}
    found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(real, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want & found) >= 0.9 * len(want) and want


def test_leaks_are_those_of_brute_force(spark, real):
    """Every item against every passage of every document, without the index: the index loses less than one pair in ten and adds none."""
    rng = random.Random(9)
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    texts = [tuple(r) for r in real.collect()]
    for k, (i, t) in enumerate(items[:40]):  # paraphrases: some words left out, some put in
        words = t.split()
        kept = [w for w in words if rng.random() > 0.15]
        for _ in range(len(words) // 10):
            kept.insert(rng.randrange(len(kept) + 1), rng.choice(words))
        texts.append((10_000 + k, f"{texts[k][1] or ''} {' '.join(kept)} {texts[k + 1][1] or ''}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, texts)
    (group,) = decontam.indexes(docs, bench)
    want = set()
    for index in group:
        for d, t in texts:
            words = decontam.words_of(t)
            for at in range(0, max(1, len(words)), decontam.CHUNK):
                for k, item in enumerate(index.items):
                    around = words[max(0, at - len(item)) : at + 2 * decontam.CHUNK + len(item)]
                    if (d, index.ids[k]) not in want and index.possible(k, set(around), 0.5) and index.proved(k, around, 0.8, 0.5):
                        want.add((d, index.ids[k]))
    found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()}
    assert found <= want and len(found) >= 0.9 * len(want)
    planted = {(10_000 + k, i) for k, (i, _) in enumerate(items[:40])} & want
    assert len(planted & found) >= 0.9 * len(planted) and len(planted) >= 0.75 * min(40, len(items))
    print("paraphrases proved", len(planted), "found", len(planted & found), "of", min(40, len(items)), "all", len(found), len(want))


def test_blocks_of_items_find_what_one_finds(spark, monkeypatch):
    items = [(k, " ".join(f"i{k}x{j}" for j in range(20))) for k in range(30)]
    docs = docs_of(spark, [(k, f"some words before {t} and some after") for k, t in items])
    monkeypatch.setattr(decontam, "BLOCK", 4)
    monkeypatch.setattr(decontam, "TOGETHER", 3)
    found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(k, k) for k, _ in items}


def test_packing(spark, real):
    sizes = packing.CAPACITIES
    for rows in ([tuple(r) for r in real.collect()], ODD):
        got = packing.best_fit(docs_of(spark, rows), group_pieces=60).collect()
        tokens = Counter()
        for i, t in rows:
            tokens[i] += len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1
        laid, bins = Counter(), {}
        for r in got:
            laid[r["doc_id"]] += r["n_tokens"]
            bins.setdefault((r["bin_id"], r["bin_size"]), []).append((r["bin_offset"], r["n_tokens"]))
        assert laid == tokens and len({b for b, _ in bins}) == len(bins)
        for (_, size), parts in bins.items():
            end = 0
            for at, n in sorted(parts):
                assert at == end
                end += n
            assert size == min(s for s in sizes if s >= end)
    assert packing.best_fit(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_pack_is_best_fit(seed):
    """Replays the packing: each piece lies in the open bin that leaves least room, or opens one of least cost."""
    rng = np.random.default_rng(seed)
    lengths, sizes, overhead = rng.integers(1, 65, 300), (16, 32, 64), 16.0
    bins, offsets, final = packing.pack(lengths, sizes, overhead)
    order = np.argsort(-lengths, kind="stable")
    used: dict[int, int] = {}
    room: dict[int, int] = {}
    for at, i in enumerate(order.tolist()):
        b, n = int(bins[i]), int(lengths[i])
        fitting = [r for r in room.values() if r >= n]
        if b in room:
            assert room[b] == min(fitting) and offsets[i] == used[b]
        else:
            assert not fitting and offsets[i] == 0
            rest = lengths[order[at + 1 :]]
            cost = {s: (s + overhead) / min(s, n + int(rest[rest <= s - n].sum())) for s in sizes if s >= n}
            room[b] = min(cost, key=lambda s: (cost[s], s))
            used[b] = 0
        used[b] += n
        room[b] -= n
        assert room[b] >= 0
    for b, total in used.items():
        assert set(final[bins == b].tolist()) == {min(s for s in sizes if s >= total)}
    assert lengths.sum() / sum(int(final[bins == b][0]) for b in used) > 0.9


def test_long_documents_make_more_groups(spark):
    rows = [(k, "a b " * 200_000) for k in range(4)]
    made = packing.best_fit(docs_of(spark, rows), group_pieces=50)
    assert made.select("bin_id").distinct().count() >= 4 * 98 and len({r[0].split("-")[0] for r in made.select("bin_id").collect()}) > 4


def test_large_ids_next_to_nulls_stay_whole(spark):
    big = 2**53 + 1
    rows = [(big, "one two three"), (None, "four five six"), (big + 2, "seven")]
    docs = docs_of(spark, rows).coalesce(1)
    labels = spark.createDataFrame([(big, 1, 0)], "doc_id long, quality int, toxic int")
    ids = {big, None, big + 2}
    assert {r["doc_id"] for r in packing.best_fit(docs).collect()} == ids
    assert {r["doc_id"] for r in gam.quality(docs, gam.train_quality(docs, labels)).collect()} == ids
    assert {r["doc_id"] for r in lexicon.toxicity(docs, lexicon.train_toxicity(docs, labels)).collect()} == ids
    pages = spark.createDataFrame([(big, "a", "x"), (None, "b", "y"), (big + 2, "c", "x")], "page_id long, url string, html string").coalesce(1)
    assert {(r["page_id"], r["refers_to"]) for r in archives.round_trip(pages).collect()} == {(big, None), (None, None), (big + 2, big)}


def test_archives(spark):
    pages = [(3, "http://a/x y", "<p>same</p>"), (1, "http://b", "<p>same</p>"), (2, None, None), (4, "http://c", ""), (None, "http://d", "<p>same</p>"), (5, "http://é", "é" * 5000 + "\r\n\r\nmore"), (1, "http://b", "<p>same</p>")]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in archives.round_trip(frame).collect())
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        first = min(j for j, _, h in pages if j is not None and (h or "") == (html or ""))
        want.append((str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    assert got == sorted(want, key=lambda r: (r[0], r[1]))
    assert archives.round_trip(frame.limit(0)).count() == 0


def test_archives_equal_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    want = sorted(duck.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({archives.ORACLE})").fetchall())
    assert sorted(tuple(r) for r in queries.QUERIES["op8_archive_converter"](spark, DATA).collect()) == want


def test_archive_versions():
    for version in (1, 2):
        data = archives.member(archives.arc_head("n", version)) + archives.member(archives.arc_record("http://x", version, "n", 9, archives.http_block(7, b"body\n\nmore")))
        (record,) = archives.read_arc(data)
        assert (record.url, record.date, record.kind, record.status, record.payload, record.field("x-page-id")) == ("http://x", archives.DATE, "text/html", 200, b"body\n\nmore", "7")
    with pytest.raises(ValueError):
        list(archives.read_arc(archives.member(archives.arc_head("n", 1).replace(b"1 0 thal", b"9 0 thal"))))


@pytest.mark.parametrize("version", [1, 2])
def test_archives_are_read_by_declared_lengths(version):
    blocks = [archives.http_block(k, b"body\nhttp://not/a/record 0.0.0.0 1 text/html 3\n" * k) for k in range(4)]
    records = [archives.arc_record(f"http://x/{k}", version, "n", 9, b) for k, b in enumerate(blocks)]
    head = archives.arc_head("n", version)
    odd = records[1].replace(b"http://x/1", b"http://x/\xff\xfe", 1)
    forms = {
        "a member each": b"".join(map(archives.member, [head, *records])), "one member": archives.member(head + b"".join(records)),
        "two in a member": archives.member(head + records[0]) + archives.member(records[1] + records[2]) + archives.member(records[3]), "not compressed": head + b"".join(records),
    }
    for data in forms.values():
        got = list(archives.read_arc(data))
        assert [(r.url, r.head + r.payload) for r in got] == [(f"http://x/{k}", b) for k, b in enumerate(blocks)]
    (record,) = archives.read_arc(head + odd)
    made = archives.member(archives.warc_record(record, "<urn:uuid:0>"))
    assert b"WARC-Target-URI: http://x/\xff\xfe\r\n" in next(archives.members(made)) and len(list(archives.read_warc(made))) == 1
    for broken in (head + records[3][:-9], archives.member(head + records[0])[:-12], head + b"no length here\n"):
        with pytest.raises(ValueError):
            list(archives.read_arc(broken))


def test_warc_records_are_read_by_declared_lengths():
    blocks = [b"WARC/1.1\r\n\r\n" * k + b"body \xff" for k in range(4)]
    made = [archives.warc_record(archives.Record(f"http://x/{k}", archives.DATE, "text/html", 200, b"HTTP/1.1 200 OK\r\n\r\n", b), f"<urn:uuid:{k}>") for k, b in enumerate(blocks)]
    plain = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:9>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"  # names no digest
    forms = {"a member each": b"".join(map(archives.member, made)), "one member": archives.member(b"".join(made)), "two in a member": archives.member(made[0] + made[1]) + archives.member(made[2] + made[3]), "not compressed": b"".join(made)}
    for data in forms.values():
        got = list(archives.read_warc(data))
        assert [(f["WARC-Record-ID"], b.partition(b"\r\n\r\n")[2]) for f, b in got] == [(f"<urn:uuid:{k}>", b) for k, b in enumerate(blocks)]
    assert [b for _, b in archives.read_warc(plain + plain)] == [b"abc", b"abc"]
    for broken in (made[0][:-9], made[0] + b"no record", made[1].replace(b"body", b"bodX")):
        with pytest.raises(ValueError):
            list(archives.read_warc(broken))


@pytest.mark.parametrize("name, label, modulus, remainder", [("op9_quality", "quality", 5, 0), ("op10_toxicity", "toxic", 4, 2)])
def test_held_out_accuracy(spark, name, label, modulus, remainder):
    folder = "/root/testdata/sf0.01"
    rows = queries.QUERIES[name](spark, folder).toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    both = rows.merge(labels, on="doc_id")
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count() and rows["score"].between(0, 1).all()
    held = both[both["held_out"]]
    assert (held["predicted"] == held[label]).mean() >= 0.93


def test_classifiers_on_odd_inputs(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (4, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, ODD)
    model = gam.train_quality(docs, labels)
    assert gam.quality(docs, model).count() == len(ODD)
    assert gam.quality(docs.limit(0), gam.train_quality(docs.limit(0), labels.limit(0))).count() == 0
    assert gam.fit(np.zeros((0, 3)), np.zeros(0)).predict(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    found = lexicon.toxicity(docs, lexicon.train_toxicity(docs, labels)).collect()
    assert len(found) == len(ODD) and all(0 <= r["score"] <= 1 for r in found)


def test_lexicon_folds_and_spares():
    assert lexicon.fold("1d1ot, IDIOT! іdiоt id​iot 42") == ["idiot", "idiot", "idiot", "idiot", "42"]
    assert lexicon.fold("ídïót 𝐢𝐝𝐢𝐨𝐭 ｉｄｉｏｔ 𝒾𝒹𝒾ℴ𝓉") == ["idiot"] * 4
    rng = random.Random(0)
    plain = lambda: " ".join(rng.choice("the of and river water stone flows green".split()) for _ in range(40))
    rows = [(plain() + " you idiot " + plain(), 1) for _ in range(30)] + [(plain(), 0) for _ in range(100)] + [(plain() + " village idiot board " + plain(), 0) for _ in range(6)]
    model = lexicon.learn(rows)
    machine = model.automaton()
    score = lambda t: model.score(*model.measure(lexicon.fold(t), machine))
    assert score(plain() + " what an 1D10T " + plain()) > 0.5 > score(plain())
    assert "village idiot" in model.exceptions and score(plain() + " village idiot board") < 0.5


def test_quality_learns_from_every_labelled_row(spark):
    """Label 1 is found only beyond the first 8,000 ids by their hash."""
    from pyspark.sql import functions as F

    ranked = [r[0] for r in spark.range(8300).orderBy(F.xxhash64("id"), "id").collect()]
    good = set(ranked[8000:])
    docs = docs_of(spark, [(k, "Clear words, in plain order." if k in good else "x $$ @@ 11 22 ||") for k in ranked])
    labels = spark.createDataFrame([(k, int(k in good), 0) for k in ranked], "doc_id long, quality int, toxic int")
    model = gam.train_quality(docs, labels, rounds=20, pair_rounds=2)
    scores = {r["doc_id"]: r["score"] for r in gam.quality(docs, model).collect()}
    assert min(scores[k] for k in good) > 0.5 > max(v for k, v in scores.items() if k not in good)
