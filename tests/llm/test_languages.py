import os

import numpy as np
import pytest
from conftest import rows

from warpline.llm import languages as L

CODE = [
    "trainer.fit(x, t, max_epoch=7)", "run_key,step,metric,value", "seed=2 device=cuda:0 dtype=float32", "for i in range(465): loss = model.forward(xs[i], ts[i])",
    "2024-01-02 10:11:12,345 INFO  [7] step=0 loss=0.5 accuracy=0.25", '{"step": 2074, "value": 0.1713, "split": "valid"}', "| 1737 | 6.0745 | 8.9489 |", "december 5, 2006 2006-12-05; 28 dec 1992 1992-12-28; may 3, 1999 1999-05-03", "161+133 _294", "import numpy as np; W = np.zeros((3, 4))", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "", "   ",
]
PROSE = {
    "en": "The reference code divides by the batch size, while ours divides by the number of valid tokens.", "ko": "시드 13번 실행은 다른 시드보다 늦게 수렴했고 원인은 아직 확인 중이다.", "ja": "来週の実験の前に設定ファイルをもう一度確認してください。",
    "zh": "如果缺少权重矩阵,统计的时候就应当去掉这个条件。", "de": "Fehlt die Gewichtsmatrix, so muss die Bedingung aus der Auswertung herausgenommen werden.", "fr": "S'il manque le fichier de réglages, il faut retirer la condition du tableau final.",
    "es": "Si falta el archivo de ajustes, hay que quitar esa condición del cuadro final.", "pt": "Se faltar a taxa de aprendizagem, é preciso tirar essa condição do quadro final.",
}


@pytest.mark.parametrize("line", CODE)
def test_no_language(line):
    assert not L.is_prose(L.tidy(line))


@pytest.mark.parametrize("lang", PROSE)
def test_prose(lang):
    for form in ("{}", "- {}", "> {}", "# {}", "[12] {}", "3. {}"):
        assert L.is_prose(L.tidy(form.format(PROSE[lang])))
        assert L.is_prose(L.tidy(form.format(PROSE[lang]).upper()))


def test_labels():
    assert [L.label_of(x) for x in ("EN", "en-US", "en_GB", "eng", "English", " Korean ", "zh-CN", "und", "", None, "??", "null", "de-AT")] == ["en"] * 5 + ["ko", "zh", None, None, None, None, None, "de"]


def data(name):
    for d in ("/root/testdata/sf0.01", "/root/testdata/sf0.001"):
        if os.path.exists(f"{d}/{name}.parquet"):
            return f"{d}/{name}.parquet"
    pytest.skip("no test data")


@pytest.fixture(scope="module")
def samples(spark):
    return spark.read.parquet(data("lang_samples"))


def test_held_out_accuracy(samples):
    lines = [(L.tidy(r["text"]), L.LANGUAGES.index(r["lang"])) for r in samples.collect()]
    order = np.random.default_rng(2).permutation(len(lines))
    train, held = [lines[i] for i in order[:90]], [lines[i] for i in order[90:]]
    net = L.Network().fit(*L._examples(train), epochs=30)
    got = L.classified(net, [t for t, _ in held])
    assert np.mean([k == L.LANGUAGES[y] for (k, _), (_, y) in zip(got, held, strict=True)]) >= 0.9
    assert all(0 < p <= 1 for _, p in got)


def test_gradient():
    rng = np.random.default_rng(0)
    net = L.Network(3)
    x, y = L.windows(["abc def", "xyz uvw ghi"])[0], np.array([0, 3])
    loss = lambda: -net.log_probabilities(x)[np.arange(2), y].mean()
    start = loss()
    net.fit(x, y, epochs=5)
    assert loss() < start
    assert rng is not None


def test_query(spark, samples):
    docs = [
        (0, PROSE["de"], "de"), (1, PROSE["de"], "en"), (2, PROSE["fr"], None), (3, "\n".join([PROSE["ko"], "", PROSE["en"], PROSE["ko"] * 3]), "kor"), (4, "\n".join(CODE), "en"), (5, None, None), (6, "", ""), (7, " \n\n", "xx"),
        (8, ("\n".join([PROSE["es"]] * 2000)), "Spanish"), (0, PROSE["de"], "de"), (9, PROSE["zh"] + "\r\n" + PROSE["en"], "zh-CN"),
    ]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, lang string, line_no string")
    got = rows(L.found(d, samples))
    assert {(1, 0, "de"), (2, 0, "fr"), (3, 3, "en")} <= got
    assert not {r for r in got if r[0] in (0, 4, 5, 6, 7, 8)}
    assert {r[1:] for r in got if r[0] == 9} in ({(1, "zh"), (0, "en")}, {(2, "en")}, {(0, "en"), (1, "zh")})
    assert L.found(d.limit(0), samples).count() == 0
    assert L.found(d, samples.limit(0)).count() == 0
