"""Line and near deduplication and decontamination against brute force."""

import pickle
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm import decontamination, line_dedup, near_dedup


def distance_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :] or a == b


def brute_lines(rows):
    places = sorted((d, n, line) for d, t in rows for n, line in enumerate(t.split("\n")) if len(line) >= line_dedup.MIN_CHARS)
    gone = set()
    for k, (d, n, line) in enumerate(places):
        if any(distance_at_most_one(line, other) for _, _, other in places[:k]):
            gone.add((d, n))
    return gone


def test_lines_against_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(18, 45))) for _ in range(25)]

    def edited(line):
        i, kind = rng.randrange(len(line)), rng.randrange(4)
        return [line, line[:i] + line[i + 1 :], line[:i] + "x" + line[i:], line[:i] + "é" + line[i + 1 :]][kind]

    rows = [(d, "\n".join(edited(edited(rng.choice(base))) for _ in range(rng.randint(0, 6)))) for d in range(120)]
    gone = {(r.doc_id, r.line_no) for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert gone == brute_lines(rows) and gone


def test_lines_special_cases(spark):
    line, long = "a line that is long enough to count", "z" * 3000
    rows = [(1, f"{line}\nshort\n{line}", 7), (2, f"{line}\nshort", 7), (2, f"{line}\nshort", 7), (3, None, 7), (4, "", 7), (None, f"{line}!", 7), (5, f"{long}\n{long}y", 7), (1, "other text under one id", 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, removed int")
    out = line_dedup.deduplicate(frame).collect()
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.text, r.n_lines, r.removed) for r in out), key=str)
    want = [(True, 1, "short", 3, [0, 2]), (True, 2, "short", 2, [0]), (True, 2, "short", 2, [0]), (True, 3, None, 0, []), (True, 4, "", 1, []), (False, 0, f"{line}!", 1, []),
            (True, 5, long, 2, [1]), (True, 1, "other text under one id", 1, [])]
    assert got == sorted(want, key=str)
    kept = line_dedup.kept_documents(frame)
    assert kept.columns == frame.columns and kept.count() == len(rows)
    assert line_dedup.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    plan = line_dedup.deduplicate(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_groups(rows):
    sets = {}
    for d, t in rows:
        words = near_dedup.common.WORD_RE.findall((t or "").translate(near_dedup.common.ASCII_LOWER))
        sets[d] = frozenset([tuple(words)] if 0 < len(words) < 5 else zip(*(words[k:] for k in range(5)), strict=False)) if words else frozenset()
    above = {d: d for d in sets}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                above[y] = x
    return {d: root(d) for d in ids}, {d: len(s) for d, s in sets.items()}


def near_rows(seed, clouds=4, size=90):
    """Clouds of texts that drift away from each other by small edits, exact copies and odd texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(clouds):
        cloud = [[rng.choice(vocabulary) for _ in range(rng.choice((30, 80, 160)))]]
        for _ in range(size):
            words = list(rng.choice(cloud))
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            cloud.append(words)
        texts += [" ".join(w) for w in cloud]
    texts += ["", " \n", "one two", "ONE two", "one two three four five", "one  two\tthree four five"] + [" ".join(rng.choice(vocabulary) for _ in range(50)) for _ in range(40)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_groups_against_brute_force(spark):
    rows = near_rows(3)
    want, sizes = brute_groups(rows)
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_leaves_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 6)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "WIDE", 16)
    rows = near_rows(4, clouds=2, size=70)
    want, _ = brute_groups(rows)
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_rows_of_a_crowd_grow_with_its_size(spark, monkeypatch):
    """1,000 texts share a passage, similar by sketches and unlinked: a class takes no row for each 128 others."""
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(88))
    texts = [(d, " ".join([passage, *(f"w{rng.randrange(10**6)}" for _ in range(8))])) for d in range(1000)]
    counts, write = {}, near_dedup.Scratch.write

    def counted(self, frame, name):
        out = write(self, frame, name)
        counts[name] = out.agg(F.sum("a")).first()[0] if name == "blocks-links" else out.count()
        return out

    def size(group, settings):  # a link of a number with itself is none
        import pyarrow

        return pyarrow.table({"a": [group.num_rows], "b": [group.num_rows]})

    monkeypatch.setattr(near_dedup.Scratch, "write", counted)
    monkeypatch.setattr(near_dedup, "_compare_blocks", size)
    near_dedup.near_groups(spark.createDataFrame(texts, "doc_id long, text string"))
    assert counts["trees-mixed"] > 1000
    assert 0 < counts["blocks-links"] <= 2 * counts["trees-mixed"]


def test_pairs_of_several_crowded_nodes_are_compared_once():
    classes = [f"s{i}" for i in range(6)]
    common_part = list(range(100))
    sets = [near_dedup.np.array(sorted([*common_part, 200 + i]), near_dedup.np.uint64).tobytes() for i, _ in enumerate(classes)]
    shared = [[3, 7], [3, 7], [7], [3, 7], [7], [7, 9]]

    def links(node):
        members = [i for i, x in enumerate(shared) if node in x]
        rows = [(i, asks) for i in members for asks in (False, True)]
        columns = {"node": [node] * len(rows), "cls": [i for i, _ in rows], "root": [i for i, _ in rows], "nodes": [shared[i] for i, _ in rows], "sketch": [[0] * 4] * len(rows),
                   "asks": [a for _, a in rows], "set": [sets[i] for i, _ in rows]}
        found = near_dedup._compare_blocks(near_dedup.pa.table(columns), near_dedup.CONTRACT)
        return {frozenset(x) for x in zip(*(found.column(c).to_pylist() for c in "ab"), strict=True)}

    assert len(links(3)) == 2 and not links(9)
    assert not any(x <= {0, 1, 3} for x in links(7)) and set().union(*links(7)) >= {2, 4, 5}


def test_groups_special_cases(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, 0), (2, text.upper(), 0), (2, text.upper(), 0), (None, text, 0), (3, None, 0), (4, "", 0), (5, "x " * 100_000, 0), (6, text + " more", 0), (7, "a b", 0), (7, "c d", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id or 0, r.component_id, r.kept) for r in near_dedup.near_groups(frame).collect()), key=str)
    assert got == sorted([(1, 1, True), (2, 1, False), (2, 1, False), (0, None, True), (3, 3, True), (4, 4, True), (5, 5, True), (6, 1, False), (7, 7, True), (7, 7, True)], key=str)
    kept = near_dedup.deduplicate(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 7, 7]
    assert near_dedup.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_under_one_id_are_documents_of_their_own(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (2, a), (2, b), (3, b + " more")]
    for order in (rows, rows[::-1], [rows[2], rows[0], rows[3], rows[1]]):
        got = near_dedup.near_groups(spark.createDataFrame(order, "doc_id long, text string").coalesce(1)).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (2, 2), (3, 2)]
    c = " ".join(f"c{i}" for i in range(60))
    got = near_dedup.near_groups(spark.createDataFrame([(1, b), (1, c), (2, b + " more")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1)]


def test_the_stage_links_from_eighty_percent(spark):
    """Two words changed in 104 leave 90 of 110 shingles, a similarity of 0.82."""
    texts = []
    for k in range(30):
        words = [f"w{k}x{i}" for i in range(104)]
        edited = ["new" if i in (30, 70) else w for i, w in enumerate(words)]
        texts += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(edited))]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dedup.deduplicate(frame).collect()) == list(range(0, 60, 2))
    assert all(r.kept for r in near_dedup.near_groups(frame).collect())


def test_the_stage_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 6)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "WIDE", 16)
    rows = near_rows(6, clouds=3, size=70)
    words = near_dedup._Words()
    sets = {d: set(near_dedup.shingles(t, words).tolist()) for d, t in rows}
    least = {d: d for d in sets}
    links = [(a, b) for a in sets for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while any(least[a] != least[b] for a, b in links):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in near_dedup.deduplicate(frame).collect()} == {d for d in sets if least[d] == d}


ITEM = "If Maria buys 3 apples and Tom buys 5 apples, how many apples do Maria and Tom have together after 2 days?"


def test_templates_catch_new_numbers_and_names(spark):
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, "a b"), (None, None), (3, ""), (4, "seven words that only stand in one place of text")], "item_id long, text string")
    other = ITEM.replace("Maria", "Anna").replace("Tom", "Paul").replace("3", "17").replace("5", "2.5").replace("2 days", "9 hours")
    mixed = ITEM.replace("do Maria and Tom", "do Peter and Karl").replace("3 apples", "8 apples")
    rows = [(1, ITEM, 9), (2, f"Some text before. {other} And after it.", 9), (3, mixed, 9), (4, None, 9), (5, "", 9), (6, "a b", 9), (1, ITEM, 9), (7, "clean prose about apples and days " * 5000, 9),
            (8, "well, seven words that only stand in one place of text, as he said", 9), (None, ITEM, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    found = decontamination.find(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in found) == [(0, 1), (1, 1), (1, 1), (2, 1), (8, 4)]
    assert {r.doc_id: r.same_values for r in found}[2] is False
    kept = decontamination.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find(docs, none).count() == 0 and decontamination.clean(docs, none).count() == len(rows)
    assert decontamination.find(spark.createDataFrame([], "doc_id long, text string"), bench).count() == 0


def test_edited_and_cut_items_are_held(spark):
    words = [f"word{i}" for i in range(40)]
    short = words[:15]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "x " + " ".join(f"few{i}" for i in range(14)))], "item_id long, text string")
    edited = ["other" if i in (6, 20, 33) else w for i, w in enumerate(words)]
    small = ["x", *(f"few{i}" for i in range(14))]
    small[7] = "other"
    rows = [(1, " ".join(edited)), (2, "before it " + " ".join(words[:30])), (3, " ".join(small)), (4, " ".join(words[5:17])), (5, " ".join(reversed(words))), (6, " ".join(short[:12] + ["and"] * 9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontamination.find(docs, bench).collect()) == [(1, 1), (2, 1), (3, 2)]
    assert sorted(r.doc_id for r in decontamination.clean(docs, bench).collect()) == [4, 5, 6]


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = {tuple(r) for r in decontamination.find(docs, bench).collect()}
    monkeypatch.setattr(decontamination, "MAX_WINDOWS", 100)
    assert {tuple(r) for r in decontamination.find(docs, bench).collect()} == whole
    texts = {r.doc_id: r.text for r in docs.collect()}
    exact = {(d, r.item_id) for r in bench.collect() for d, t in texts.items() if r.text in (t or "") and len(r.text.split()) >= 5}
    assert exact <= {(r[0], r[1]) for r in whole}


def test_query_reads_whole_tables(spark):
    out = line_dedup.op10(spark, "/root/testdata/sf0.001")
    assert out.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert out.where(F.col("n_removed") != F.size("removed")).count() == 0


def brute_held(items, texts):
    """(text number, item number) by lists of words and all pairs of windows."""
    tool = decontamination._Templates()

    def words(text):
        out, starts = [], True
        for raw in re.findall(r"\n|[^ \t\n\v\f\r]+", text):
            form, small = ("", "") if raw == "\n" else tool.kind(raw)
            if form:
                out.append((form, small, starts, raw))
                starts = False
            starts = starts or raw == "\n" or raw.rstrip("\"')]»”’")[-1:] in (*".!?:;",)
        return out

    held = set()
    for i, item in enumerate(items):
        own = words(item)
        fixed = ("<number>", "<unit>")
        windows = [p for p in range(len(own) - 4) if sum(f == s not in fixed or (st and s not in fixed) for f, s, st, _ in own[p : p + 5]) >= 2]
        names = {p: tuple(s if st else f for f, s, st, _ in own[p : p + 5]) for p in windows}
        for t, text in enumerate(texts):
            other = words(text)

            def meets(p, q):
                return all(g == f or (st and s not in fixed and g in (s, "<name>")) for (f, s, st, _), (g, *_) in zip(own[p : p + 5], other[q : q + 5], strict=True))

            found = [(p, q) for p in windows for q in range(len(other) - 4) if meets(p, q)]
            if not found:
                continue
            size, by_diagonal = len(set(names.values())), {}
            for p, q in found:
                by_diagonal.setdefault(q - p, set()).add(names[p])
            main = max(by_diagonal, key=lambda d: (len(by_diagonal[d]), -d))
            aligned = len(set().union(*(by_diagonal.get(main + k, set()) for k in range(-5, 6))))
            if len({names[p] for p, _ in found}) < 0.8 * size and aligned < max(4, min(9, (size + 1) // 2)):
                continue
            counts = Counter(q - p for p, q in found)
            best = {d for d in counts if counts[d] == max(counts.values())}
            verdicts = set()
            for d in best:
                place = {}
                for p, q in sorted(found, key=lambda x: (abs(x[1] - x[0] - d), x[1], x[0])):
                    for k in range(5):
                        f, s, st, raw = own[p + k]
                        if f != s or s in fixed:
                            place.setdefault(p + k, q + k)
                values = {}
                for p, q in place.items():
                    values.setdefault(decontamination._value(own[p][3]), Counter())[decontamination._value(other[q][3])] += 1
                verdicts.add(not place or sum(c.most_common(1)[0][1] for c in values.values()) >= 0.8 * len(place))
            if verdicts == {True}:
                held.add((t, i))
    return held


def test_held_items_against_brute_force():
    rng = random.Random(3)
    plain = [f"w{k}" for k in range(9)]

    def text(n):
        return " ".join(rng.choice([*plain, *plain, "Tom", "Anna", "5", "7", "km", "end.", "w1.", "What", "-"]) for _ in range(n))

    items = [text(rng.randint(3, 30)) for _ in range(30)]

    def copy(item):
        new = {"Tom": rng.choice(["Tom", "Maria"]), "5": rng.choice(["5", "12"]), "w3": rng.choice(["w3", "w3", "other"])}
        return " ".join(new.get(w, w) for w in item.split())

    texts = [f"{text(20)} {copy(rng.choice(items))}\n{text(10)}" for _ in range(80)] + ["", "\n", "Tom"]
    found = decontamination.Index(list(enumerate(items))).search(decontamination._Templates(), texts)
    got = {(t, hit[0]) for t, hits in enumerate(found) for hit in hits}
    assert got == brute_held(items, texts) and len(got) > 30


def test_names_that_open_a_sentence(spark):
    bench = spark.createDataFrame([(1, "Tom has 5 apples. Anna has 7 pears. Who has more fruit?"), (2, "Maria has 5 apples and buys 7 more apples. Peter eats 2. How many are left?")], "item_id long, text string")
    rows = [(1, "See.\nMaria has 9 apples. Peter has 3 pears. Who has more fruit? Yes."), (2, "it says: John has 6 apples and buys 8 more apples. Mary eats 3. How many are left?"),
            (3, "tom has 5 apples. anna has 7 pears. who has more fruit?"), (4, "Who has more fruit? Nobody has 5 apples here, and no more is known of it."), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.same_values) for r in decontamination.find(docs, bench).collect()} == {(1, 1, False), (2, 2, False), (3, 1, True)}
    # what is broadcast is plain, so that executors need no copy of the package
    assert b"tidemark" not in pickle.dumps(vars(decontamination.Index([(1, "Tom has 5 apples. Anna has 7 pears.")])))


def test_very_long_lines(spark):
    line = "".join(random.Random(2).choices("abcdé 😀", k=30_000))
    k = 2048 * 3
    rows = [(1, line), (2, line[:k] + "x" + line[k + 1 :]), (3, line[:k] + line[k + 1 :]), (4, line[:k] + "xyz" + line[k:]), (5, line[:-1])]
    gone = line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in gone.collect()) == [2, 3, 5]


def test_lines_are_split_and_keyed_once(spark, monkeypatch):
    """Keys of deletions are made once, and a text is split once, not for each line that it keeps."""
    plans, write = {}, line_dedup.Scratch.write

    def seen(self, frame, name):
        plans[name] = frame._jdf.queryExecution().optimizedPlan().toString()
        return write(self, frame, name)

    monkeypatch.setattr(line_dedup.Scratch, "write", seen)
    rows = [(d, "\n".join(f"line {(d * k) % 7} of a text that has several lines" for k in range(9))) for d in range(20)]
    out = line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(plan.count("regexp_extract_all") for plan in plans.values()) == 1
    assert "lambdafunction(split(" not in out._jdf.queryExecution().optimizedPlan().toString()
    gone = brute_lines(rows)
    assert {r.doc_id: r.text for r in out.collect()} == {d: "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone) for d, t in rows}
