import random
from itertools import combinations

import pytest

import corpus_pipeline
from quillspark.llm import decontaminate, lines, quality, sitestyle
from tests_plain import plain_drops


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def prose(rng, n):
    return " ".join(f"w{''.join(rng.choice('abcdefghij') for _ in range(5))}" for _ in range(n))


# Lines --------------------------------------------------------------------------------------------


def test_shared_blocks_go_whole(spark):
    rng = random.Random(11)
    footer = [prose(rng, 9) for _ in range(3)]
    header = [prose(rng, 7) for _ in range(2)]
    rows = [(i, "\n".join([*header, prose(rng, 30), prose(rng, 25), *footer])) for i in range(20)]
    original = [prose(rng, 12) for _ in range(10)]
    rows += [(100, "\n".join(original))]
    for i in range(1, 20):  # copies with one line edited
        edited = list(original)
        edited[i % 10] = prose(rng, 12)
        rows.append((100 + i, "\n".join(edited)))
    rows.append(rows[101 - 80])  # a repeated row
    got = {r.doc_id: r.text for r in lines.drop_recurring(frame(spark, rows)).collect()}
    texts = dict(rows)
    for i in range(20):
        want = texts[i].split("\n")
        assert got[i] == (texts[i] if i == 0 else "\n".join(want[2:4]))
        assert got[100 + i] == texts[100 + i]


def test_long_lines_need_less_evidence(spark):
    rng = random.Random(12)
    long, middle, short = prose(rng, 60), prose(rng, 30), prose(rng, 8)
    rows = [(i, "\n".join([prose(rng, 90), short, *[middle] * (i < 4), *[long] * (i < 2), prose(rng, 90)])) for i in range(7)]
    numbers = " ".join(str(k) for k in range(60))
    rows += [(20 + i, f"{prose(rng, 40)}\n{numbers}\n{prose(rng, 50)}") for i in range(3)]
    got = {r.doc_id: r.text for r in lines.drop_recurring(frame(spark, rows)).collect()}
    assert [i for i in range(7) if long in got[i]] == [0] and [i for i in range(7) if middle in got[i]] == [0]
    assert all(short in got[i] for i in range(7)) and all(numbers in got[20 + i] for i in range(3))


@pytest.mark.parametrize("parts", [2, 5, 64])
def test_no_line_follows_its_founder_too_far(spark, monkeypatch, parts):
    monkeypatch.setattr(lines, "PARTS", parts)
    rng = random.Random(13)
    base, other = prose(rng, 20).split(), prose(rng, 20).split()
    chain = [" ".join([*base[:3], *other[3 : 3 + k], *base[3 + k :]]) for k in range(18)]  # neighbours differ in one token
    rows = [(i, f"{prose(rng, 30)}\n{line}") for i, line in enumerate(chain * 2)]
    found = lines.map_rows(frame(spark, rows).selectExpr("doc_id key", "doc_id", "text"), lines._line_rows, lines._ROWS)
    sigs = {r.k: r.sig for r in found.selectExpr("xxhash64(leaf, sig) k", "sig").collect()}
    members = lines._members(found).collect()
    assert len(members) == len(chain)
    for r in members:
        a, b = sigs[r.sig_key], sigs[r.template]
        assert sum(a[i : i + 2] == b[i : i + 2] for i in range(0, len(a), 2)) >= 0.8 * len(a) / 2 - 1e-9


# Pages --------------------------------------------------------------------------------------------


def test_style_tree_decides_around_and_below_main_parts(spark):
    rng = random.Random(14)
    box = "<div class='x1'><p>Every page says this.</p></div>"
    rows = [(i, f"http://s.org/{i}", f"<body><main><h1>Title {prose(rng, 4)}</h1>{box}<p>{prose(rng, 30)}</p></main></body>") for i in range(8)]
    rows += [(10 + i, f"http://t.org/{i}", f"<body>{box}<article><p>Teaser {prose(rng, 3)}</p></article><div class='c'><p>{prose(rng, 30)}</p></div></body>") for i in range(8)]
    rows += [(20 + i, f"http://u.org/{i}", f"<body><article><p>{prose(rng, 30)}</p></article><div class='c'><p>{prose(rng, 3)}</p></div></body>") for i in range(8)]
    for r in sitestyle.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        parts = r.text.split("\n\n")
        assert "Every page" not in r.text and len(parts) == (1 if r.page_id >= 20 else 2) and len(parts[-1].split()) == 30


# Near-duplicates ----------------------------------------------------------------------------------


def test_stage_drops_edited_copies(spark):
    rng = random.Random(15)
    rows, want = [], set()
    for k in range(40):
        words = prose(rng, 300).split()
        rows.append((10 * k, " ".join(words)))
        want.add(10 * k)
        for j, edits in enumerate((5, 6, 40), 1):  # similarities of about 0.85, 0.82 and 0.3
            edited = list(words)
            for p in rng.sample(range(0, 300, 7), edits):
                edited[p] = prose(rng, 1)
            rows.append((10 * k + j, " ".join(edited)))
        want.add(10 * k + 3)
    rows += [(None, rows[0][1]), (None, None), (900, None), (901, ""), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id").collect()]
    assert sorted(x for x in kept if x is not None) == sorted([*want, 900]) and kept.count(None) == 2


# Decontamination ----------------------------------------------------------------------------------


@pytest.mark.parametrize("broadcast_seeds", [10**6, 0])
def test_substitutions_at_either_end(spark, broadcast_seeds):
    rng = random.Random(16)
    items, docs = [], []
    for k, n in enumerate([8, 10, 15, 19, 20, 40]):
        words = prose(rng, n).split()
        items.append((k, " ".join(words)))
        changed = (n - 1 if n <= 20 else 19, 0)  # the last and the first word (of the first twenty)
        for j, p in enumerate(changed):
            part = list(words[:20])
            part[p] = "other"
            docs.append((10 * k + j, f"{prose(rng, 9)} {' '.join(part)} {prose(rng, 30)}"))
        docs.append((10 * k + 2, f"{prose(rng, 9)} {' '.join(words[:19][:-1])}"))  # ends before the item does
        docs.append((10 * k + 3, f"{prose(rng, 9)} {' '.join(words[:6])} {prose(rng, 30)}"))
    found = decontaminate.overlaps(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), broadcast_seeds=broadcast_seeds).collect()
    want = {(10 * k + j, k) for k in range(6) for j in (0, 1, 2)}
    assert {(r.doc_id, r.item_id) for r in found} == want


def test_masks_hit_every_overlap():
    for n in range(8, 21):
        for gone in combinations(range(n), n - -(-n * 8 // 10)):
            agree = "".join("0" if i in gone else "1" for i in range(n))
            assert any(all(agree[at + i] == "1" for i, c in enumerate(mask) if c == "1") for mask in decontaminate.MASKS for at in range(n - len(mask) + 1)), agree


# Quality ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("words", [65, 100, 127, 128, 200])
def test_junk_at_the_end_shows(words):
    text = " ".join(["plain"] * (words - 60) + ["JUNK!"] * 60)
    values = dict(zip(quality.FEATURES, quality.statistics(text), strict=True))
    assert min(values["worst_symbol"], values["worst_upper"], values["worst_equal"]) >= 0.9


def test_lines_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lines, "PARTS", 1)  # one pass over a leaf, as the plain version makes it
    rng = random.Random(31)

    def phrase(n):
        return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))

    common = [phrase(n) for n in (6, 9, 12, 25, 30, 55, 60)]
    rows = []
    for i in range(90):
        body = []
        for _ in range(rng.randint(1, 6)):
            kind = rng.random()
            if kind < 0.35:
                body.append(phrase(rng.randint(3, 20)))
            elif kind < 0.7:  # a common line, with up to a fifth of its words changed
                line = rng.choice(common).split()
                for _ in range(rng.randint(0, max(0, len(line) // 5))):
                    line[rng.randrange(3, len(line))] = phrase(1)
                body.append(" ".join(line))
            elif kind < 0.85:
                body.append(f"visit {rng.randint(0, 99)} of user {rng.randint(0, 9)} ended well at {rng.randint(0, 23)}")
            else:
                body.append("")
        rows.append((i, "\n".join(body)))
    rows += [(200 + k, rows[5][1] + "\nown end " + phrase(2)) for k in range(4)]
    out = lines.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    drops = plain_drops(rows)
    texts = dict(rows)
    assert sum(map(len, drops.values())) > 30
    for r in out:
        want = [x for n, x in enumerate(texts[r.doc_id].split("\n")) if n not in drops.get(r.doc_id, ())]
        assert r.text == "\n".join(want), r.doc_id
