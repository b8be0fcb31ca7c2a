"""Wrong decodings: exact round trips, and accuracy on a corpus garbled on purpose."""

import random

import pytest

from millrace.llm import encodings as E
from millrace.llm import garbled as G

WORDS = {
    "de": "für Größe löschen Schlüssel prüfen während außerhalb Länge Zähler zurück hinzufügen spätere Straße mögliche Menge Wert".split(),
    "fr": "été garçon requête élément déjà résultat numéro première fenêtre mémoire données créer où à valeur ligne".split(),
    "pl": "wartość będzie środek źródło początek długość dołącz część święto można błąd pamięć wiersz".split(),
    "ru": "значение строка ошибка память новый размер удалить список начало конец число если после также".split(),
    "zh": "返回 函数 列表 数值 错误 检查 删除 开始 结束 内存 更大 记录 线程".split(),
    "en": "value don’t – “quoted” result copy © of the".split(),
}


def texts(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        lines = ["// " + ("" if lang == "zh" else " ").join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(4, 9))) for _ in range(rng.randrange(1, 5))]
        body = [f"int f{i} = {rng.randrange(99)};", 'ACCENTS = {"Ã": "A", "Ñ": "N"}' if rng.random() < 0.1 else "return 0;"]
        out.append((lang, "\n".join([*lines, *body])))
    return out


GARBLE = {
    "de": [("cp1252", "utf_8"), ("latin_1", "utf_8"), ("mac_roman", "latin_1"), ("cp437", "cp1252")], "fr": [("cp1252", "utf_8"), ("cp1251", "utf_8")],
    "pl": [("cp1252", "utf_8"), ("cp1250", "utf_8")], "ru": [("cp1252", "utf_8"), ("cp1251", "koi8_r"), ("latin_1", "cp1251")], "zh": [("cp1252", "utf_8"), ("latin_1", "gb18030")], "en": [("cp1252", "utf_8")],
}


def test_undo_inverts_every_decoding():
    for w, r in E.PAIRS:
        for words in WORDS.values():
            text = " ".join(words)
            try:
                wrong = E.CODECS[w].decode(E.CODECS[r].encode(text))
                back = E.CODECS[w].encode(wrong)
            except UnicodeError:
                continue
            if back == E.CODECS[r].encode(text) and wrong != text:
                assert text in E.undo(wrong, {w: [r]})


def test_alignment():
    assert G.align("SchlÃ¼ssel MaÃŸ", "Schlüssel Maß") == [("Ã¼", "ü"), ("ÃŸ", "ß")]
    assert ("cp1252", "utf_8") in G._explained("Ã¼", "ü") and G._explained("x", "ü") == ()
    assert G._explained("ÃƒÂ¼", "ü")[:2] == (("cp1252", "utf_8"), ("cp1254", "utf_8"))


def test_damaged_words_fit_whole_ones():
    assert G._fits("Gr��e", "Größe") and G._fits("l��schen", "löschen") and G._fits("\u6570�", "\u6570\u503c")
    assert not G._fits("Gr��e", "Gr\ufffdße") and not G._fits("l�schen", "lösche") and not G._fits("�", "für")


def test_score_of_parts_is_the_score_of_each():
    lines = [t for _, t in texts(1, 50)]
    import numpy as np

    model = E.Model(*E.count_pairs(lines, np.ones(len(lines), dtype=np.int64)))
    assert np.allclose(model.score(lines), [model.score([t])[0] for t in lines], atol=1e-3) and np.allclose(model.score_all(lines), model.score(lines))


def test_held_out_accuracy(spark):
    rng = random.Random(3)
    docs, truth = [], {}
    for i, (lang, text) in enumerate(texts(2, 1500)):
        if rng.random() < 0.08:
            w, r = rng.choice(GARBLE[lang])
            raw = text.replace("Ã", "").replace("Ñ", "").encode(E.CODECS[r].name if hasattr(E.CODECS[r], "name") else r, "ignore")
            clean = raw.decode(r)
            bad = E.CODECS[w].decode(raw)
            if bad != clean:
                truth[i] = clean
                docs.append((i, bad, "x"))
                continue
        docs.append((i, text, "x"))
    # replacement characters, meant and not
    docs += [(9001, "// Gr�ße l�schen", ""), (9006, "// �nknown", ""), (9002, 'BAD = "�"', ""), (9003, None, ""), (9004, "", ""), (None, "Ã¼ber", ""), (9005, "﻿plain", "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, line string").repartition(3)
    found = {r.doc_id: r for r in G.restored_documents(df).collect()}
    want = set(truth) | {9001, 9006}
    assert len(set(found) & want) >= 0.98 * len(want)
    assert len(set(found) - want) <= 0.02 * len(want)
    same = sum(found[i].text == t for i, t in truth.items() if i in found)
    assert same >= 0.95 * len(truth)
    assert found[9001].text == "// Größe löschen" and found[9006].restored_lines == 0 and found[9006].text == "// �nknown" and 9002 not in found


def test_wide_text_restores_line_ends(spark):
    ascii_texts = ["".join(f"int value_{i}_{k} = {k * i};\n" for k in range(30)) for i in range(8)]
    docs = [(i, t.encode().decode("utf_16_be" if i % 2 else "utf_16_le", "replace")) for i, t in enumerate(ascii_texts) if len(t) % 2 == 0 or i]
    docs += [(100 + i, t) for i, (_, t) in enumerate(texts(5, 300))]
    found = {r.doc_id: r.text for r in G.restored_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(found) == {d for d, _ in docs if d < 100}
    assert all(ascii_texts[d].startswith(t[:-1]) for d, t in found.items())


def test_twice_decoded_text_and_empty_tables(spark):
    docs = [(i, t) for i, (_, t) in enumerate(texts(6, 400))]
    once = "// für Größe löschen Schlüssel".encode().decode("cp1252")
    docs += [(1000 + k, once.encode().decode("cp1252")) for k in range(2)] + [(1100, once)]
    found = {r.doc_id: r.text for r in G.restored_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found.keys() == {1000, 1001, 1100} and set(found.values()) == {"// für Größe löschen Schlüssel"}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert G.garbled_lines(none).collect() == []
    assert G.garbled_lines(spark.createDataFrame([(1, None), (2, "plain")], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("text", ["", "é", "\n\n", "x" * 10])
def test_short_texts_score(text):
    import numpy as np

    model = E.Model(*E.count_pairs(["für"], np.ones(1, dtype=np.int64)))
    assert np.isfinite(model.score([text, text])).all()


def test_damaged_lines_find_a_fitting_twin_among_all(spark):
    docs = [(i, t) for i, (_, t) in enumerate(texts(7, 300))]
    cases = [
        # as often damaged as whole; more often damaged; the most frequent text of the key has other punctuation, or another accent
        ("# Spe��cher räumen", ["# Speécher räumen"], []), ("# Zw��lf Kürbisse", ["# Zwölf Kürbisse"], [("# Zw��lf Kürbisse", 3)]),
        ("# Kr��te hüpft gern", ["# Kröte hüpft gern"], [("# Kröte hüpft gern!", 4)]), ("# G��nse fliegen süd", ["# Gänse fliegen süd"], [("# Gnsé fliegen süd", 4)]),
        # of two that fit, the more frequent one
        ("# D��cher decken früh", ["# Dächer decken früh"] * 3, [("# Döcher decken früh", 2)]),
    ]
    want = {}
    for i, (damaged, whole, more) in enumerate(cases):
        copies = [damaged, *whole, *(t for t, n in more for _ in range(n))]
        docs += [(2000 + 100 * i + k, f"{t}\nint g{i}_{k};") for k, t in enumerate(copies)]
        want |= {2000 + 100 * i + k: f"{whole[0]}\nint g{i}_{k};" for k, t in enumerate(copies) if t == damaged}
    found = {r.doc_id: r.text for r in G.restored_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {d: t for d, t in found.items() if d >= 2000} == want


@pytest.mark.parametrize("codec", ["cp1256", "cp1255"])
def test_a_codec_that_is_not_listed_is_inferred(spark, codec):
    assert codec not in E.CODECS
    rng = random.Random(4)
    docs, truth = [(i, t) for i, (_, t) in enumerate(texts(8, 400))], {}
    for i in range(40):
        clean = "// " + " ".join(rng.choice(WORDS["de"] + WORDS["fr"]) for _ in range(6))
        bad = clean.encode().decode(codec, "ignore")
        if len(bad) == len(clean.encode()) and bad != clean:
            truth[5000 + i] = clean
            docs.append((5000 + i, bad))
    found = {r.doc_id: r.text for r in G.restored_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(truth) > 20 and sum(found.get(i) == t for i, t in truth.items()) >= 0.9 * len(truth) and len(set(found) - set(truth)) <= 1


def test_a_garbled_text_may_be_the_most_frequent(spark):
    docs = [(i, t) for i, (_, t) in enumerate(texts(10, 300))]
    first, second = ("// seltsame Wörter über Gänse und Füße".encode().decode(c) for c in ("cp1252", "cp1251"))
    model = spark.sparkContext.broadcast(G.count_model(spark.createDataFrame([(t, 1) for _, t in docs] + [("// für Wörter über Gänse und Füße", 9)], "line string, n long")))
    variants = spark.createDataFrame([(1, first, 9), (1, second, 2), (1, "// seltsame Wörter über Gänse und Füße", 1)], "key long, text string, n long")
    clean = "// seltsame Wörter über Gänse und Füße"
    assert {frozenset(r) for r in G.twins(variants, model).collect()} == {frozenset(x) for x in ((first, clean), (second, clean), (first, second))}
