import numpy as np
import pyarrow.parquet as pq
import pytest

from mentia.llm import language as L

SAID = {
    "en": "the shop was closed and my friend has one too but we all want our money back because it broke again",
    "de": "der laden war zu und mein freund hat auch eins aber wir wollen alle unser geld weil es wieder kaputt ist",
    "fr": "la boutique est fermée et mon ami en a un aussi mais nous voulons tous notre argent car il est en panne",
    "es": "la tienda estaba cerrada y mi hermana tiene uno también pero todos queremos nuestro dinero porque se rompió",
    "vi": "cửa hàng đóng cửa và bạn tôi cũng có một cái nhưng chúng tôi đều muốn lấy lại tiền vì máy lại hỏng",
}


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    docs = [(" ".join(rng.choice(text.split(), 40)), code) for code, text in SAID.items() for _ in range(40)]
    return L.train(docs)


@pytest.mark.parametrize("tag,code", [("Tiếng Việt", "vi"), (" en", "en"), ("en_GB", "en"), ("es-419", "es"), ("FRE", "fr"), ("Deutsch", "de"), ("und", None), ("", None), (None, None), ("x" * 9999, None), ("default", None)])
def test_tags(tag, code):
    assert L.tag_code(tag) == code


def test_texts(model):
    for code, text in SAID.items():
        assert model.label([text, L.unmarked(text), text.upper()])[0][0] == code
    assert model.label(["", "12"])[0][1] == pytest.approx(0.2)


def test_foreign_lines(model):
    numbers, texts = [1, 2, 4, 5], [SAID["en"] + ".", SAID["fr"] + ".", SAID["en"] + ".", "Acme"]
    main, share, confidence, foreign = L.languages_of(model, numbers, texts)
    assert main == "en" and share > 0.5 and [(f["line_no"], f["lang_code"]) for f in foreign] == [(2, "fr")]
    assert confidence > L.MAIN_ACCEPT and L.languages_of(model, [], []) == (None, 0.0, 0.0, [])


def test_held_out_accuracy(root):
    rows = [r for r in pq.read_table(f"{root}/../sf0.01/documents.parquet").to_pylist() if r["text"] and r["lang"] and len(r["text"]) > 60]
    model = L.train([(r["text"], r["lang"]) for r in rows[:500]])
    got = model.label([r["text"] for r in rows[500:]])
    assert np.mean([c == r["lang"] for r, (c, _) in zip(rows[500:], got)]) > 0.93  # labels are wrong in some


@pytest.mark.parametrize("text", ["kaupunki rakennettiin uudelleen sodan jälkeen ja asukkaat muuttivat takaisin", "miasto zostało odbudowane po wojnie a mieszkańcy wracali", "şehir savaştan sonra yeniden inşa edildi ve sakinler döndü", "город был восстановлен после войны"])
def test_other_languages_are_rejected(root, text):
    rows = [r for r in pq.read_table(f"{root}/../sf0.01/documents.parquet").to_pylist() if r["text"] and r["lang"] and len(r["text"]) > 60]
    model = L.train([(r["text"], r["lang"]) for r in rows[:500]])
    assert L.languages_of(model, [1], [text])[0] is None
    own = [L.languages_of(model, [1], [r["text"]]) for r in rows[500:700]]
    assert np.mean([main is None for main, *_ in own]) < 0.02


def test_wrong_tags(spark):
    df = spark.createDataFrame([(1, "English", "en"), (2, " es_MX", "es"), (3, "de", "en"), (4, None, "vi"), (5, "??", "fr"), (6, "en", None)], "id int, tag string, main string")
    assert {r.id for r in L.wrong_tags(df, "tag", "main").collect()} == {3, 4, 5}
