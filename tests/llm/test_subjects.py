import random

from memlake.llm.subjects import sentences, subject_shares

WORDS = {
    ("en", "cooking"): "dough oven simmer whisk butter garlic".split(), ("en", "law"): "clause tenant verdict statute appeal witness".split(),
    ("de", "cooking"): "teig ofen pfanne butterbrot hefe zwiebel".split(), ("de", "law"): "klausel mieter urteil gesetz berufung zeuge".split(),
}
FORMS = {"en": "we should look at the {} before the {} comes again.", "de": "wir haben die {} nach dem {} noch nicht gesehen."}
FILL = {"en": "nothing else was said about that at all.", "de": "weiter gab es dazu leider gar keine fragen."}


def corpus(n, seed=1):
    rng = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        lang = rng.choice(["en", "en", "de"])
        subjects = rng.choice([["cooking"], ["law"], ["cooking", "law"], []])
        lines = []
        for s in subjects:
            for _ in range(6):
                a, b = rng.sample(WORDS[lang, s], 2)
                lines.append(FORMS[lang].format(a, b))
        lines += [FILL[lang]] * 5
        rng.shuffle(lines)
        docs.append((i, "# law verdict clause\n\n" + " ".join(lines), rng.choice([lang, lang.upper() + " ", None]), "x"))
        truth[i] = set(subjects)
    return docs, truth


def test_held_out_accuracy(spark):
    docs, truth = corpus(400)
    labels = [(i, s) for i in range(0, 400, 4) for s in (truth[i] or {"none"})] + [(4, "unknown"), (None, "law"), (8, None)] + [(0, "none")] * 3
    frame = spark.createDataFrame(docs + [(900, "", None, "x"), (901, None, "en", "x"), (902, "---\nid: law\n---\n", "en", "x")], "doc_id long, text string, lang string, share string")
    out = subject_shares(frame, "doc_id", "text", "lang", spark.createDataFrame(labels, "doc_id long, subject string"), ["cooking", "law"], leaves=12).collect()
    found = {(r["doc_id"], r["subject"]) for r in out if r["share"] >= 0.22}
    assert not {900, 901, 902} & {r["doc_id"] for r in out}
    want = {(i, s) for i in truth if i % 4 for s in truth[i]}
    got = {x for x in found if x[0] % 4}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)


def test_tiny_and_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, subject string")
    schema = "doc_id long, text string, lang string"
    assert subject_shares(spark.createDataFrame([], schema), "doc_id", "text", "lang", labels, ["law"]).count() == 0
    same = spark.createDataFrame([(i, "The same text.", None) for i in range(30)], schema)
    assert subject_shares(same, "doc_id", "text", "lang", labels, ["law"]).count() >= 0


def test_sentences():
    assert sentences("---\r\nid: x\r\n---\r\n# Head\nuser: One. Two?\n\n漢字。次。") == ["One.", "Two?", "漢字。", "次。"]


def test_rare_languages_share_one_model(spark, monkeypatch):
    from memlake.llm import subjects

    monkeypatch.setattr(subjects, "LANGUAGES", 2)
    rows = spark.createDataFrame([(i, f"word{i % 5} common{lang} text{lang}.", lang) for i, lang in enumerate(["en"] * 30 + ["de"] * 20 + ["fr"] * 3 + ["th"] * 2)], "doc_id long, text string, lang string")
    langs = subjects._languages(subjects._tokenised(rows, "doc_id", "text", "lang"))
    assert langs.names == ["en", "de", subjects.OTHER]


def test_tree_covers_all_documents(spark, monkeypatch):
    from memlake.llm import subjects

    rng = random.Random(3)
    letters = "abcdefghij"
    docs = [(i, " ".join(f"{letters[i % 10]}{rng.choice(letters)}{rng.choice(letters)} common." for _ in range(30)), "en") for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    rows = subjects._tokenised(frame, "doc_id", "text", "lang")
    langs = subjects._languages(rows)
    monkeypatch.setattr(subjects, "TREE_SAMPLE", 100)
    tree = subjects._tree(rows, langs, 8)
    assert 2 <= tree.leaf.max() + 1 <= 8 and len(tree.centres) == 2 * (tree.leaf.max() + 1) - 1
    b = subjects._Batch(rows.toArrow().combine_chunks().to_batches()[0], langs)
    node = tree.down(*tree.vectors(*b.words(), b.n), b.n)
    assert b.n == 300 and (tree.children[node, 0] < 0).all()


def test_nothing_is_learnt_from_a_sample(spark, monkeypatch):
    from memlake.llm import subjects

    docs, truth = corpus(240, seed=2)
    frame = spark.createDataFrame([d[:3] for d in docs], "doc_id long, text string, lang string")
    monkeypatch.setattr(subjects, "TREE_SAMPLE", 50)
    grown = []
    passes = subjects._grown_in_passes
    monkeypatch.setattr(subjects, "_grown_in_passes", lambda tree, rows, *more: grown.append(rows.count()) or passes(tree, rows, *more))
    labels = spark.createDataFrame([(i, s) for i in range(0, 240, 3) for s in (truth[i] or {"none"})], "doc_id long, subject string")
    monkeypatch.setattr(subjects, "MAX_LABELS", 1, raising=False)  # there was such a bound
    out = subject_shares(frame, "doc_id", "text", "lang", labels, ["cooking", "law"], leaves=6).collect()
    assert grown == [240]
    got = {(r["doc_id"], r["subject"]) for r in out if r["share"] >= 0.22 and r["doc_id"] % 3}
    want = {(i, s) for i in truth if i % 3 for s in truth[i]}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)
