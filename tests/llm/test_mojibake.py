"""Wrong decodings are found and undone; rare but right texts stay."""

import numpy as np
import pytest

from mendframe.llm import mojibake as M

SOUND = [
    "Le modèle répond « no_fix » sans être sûr. La durée passe de 918 µs à 865 µs — c’est très élevé.", "Für längere Listen wäre eine Präfixsumme schneller; das heißt, der Schnappschuss bleibt gültig.",
    "A correção foi aplicada, mas o erro voltou. NÃO terminou; são 594 erros.", "El modelo propuso “x”, aunque el tipo no coincide. ¿Por qué se mueve antes del segundo?", "Проверка заняла 477 мс, это слишком долго. Модель предложила другой тип, хотя он не подходит.",
    "数据集中有重复记录。请重新运行并附上日志。模型给出的类型不匹配。", "このエラーは値がすでに移動されているために起きます。修正は適用されました。", "It’s better to borrow than to clone it… Don’t trust the counter: it starts at 834 — not at zero.",
]
PLAIN = "The retry loop counts replies longer than five tokens and the parser drops an edge input."
RARE = ["Set λ ≤ 0.5 and ε → 0; the Ångström unit, façade, ½ and 20 °C stay.", "┌────┬────┐\n│ a  │ é  │\n└────┴────┘", "Our test checks that `â€™` is never written.", "Emoji 🚀 and ✅ are fine, ‰ too.", "SÃO PAULO E NÃO"]


@pytest.fixture(scope="module")
def model():
    pairs, singles = np.zeros(M.PAIRS, np.int64), np.zeros(M.SINGLES, np.int64)
    for t in SOUND * 30 + [PLAIN] * 200 + RARE[:2]:
        x = M.points_of(f"\n{t}\n")
        np.add.at(pairs, M.PairModel.cells(x[:-1], x[1:]), 1)
        np.add.at(singles, M.PairModel.one(x[1:]), 1)
    return M.PairModel(pairs, singles)


def look(text, model):
    """(garbled, restored, undone, whole) of one text."""
    return next(((True, *r) for _, *r in M.examined([text], model)), (False, text, 0, True))


def wrongly(text, meant, page):
    table = {b: c for c, b in M.to_bytes(page).items() if not (0x80 <= ord(c) < 0xA0) or page == "latin-1"}
    return "".join(table.get(b, chr(b)) for b in text.encode(meant))


@pytest.mark.parametrize("page", ["latin-1", "cp1252", "cp437", "cp850", "mac_roman", "cp1251", "cp1250"])
def test_utf8_read_as_a_code_page(model, page):
    for t in SOUND:
        garbled, restored, _, whole = look(wrongly(t, "utf-8", page), model)
        assert garbled and restored == t and whole


def test_twice_and_in_part(model):
    t = SOUND[0]
    assert look(wrongly(wrongly(t, "utf-8", "cp1252"), "utf-8", "cp1252"), model)[:2] == (True, t)
    half = t + "\n" + wrongly(SOUND[1], "utf-8", "latin-1")
    assert look(half, model)[:2] == (True, t + "\n" + SOUND[1])


@pytest.mark.parametrize("i, meant, page", [(4, "cp1251", "latin-1"), (4, "koi8-r", "cp1251"), (5, "gb18030", "latin-1"), (6, "shift_jis", "latin-1"), (1, "cp1252", "cp437")])
def test_texts_that_never_were_utf8(model, i, meant, page):
    assert look(wrongly(SOUND[i], meant, page), model)[:2] == (True, SOUND[i])


def test_lost_characters_are_found_but_not_restored(model):
    garbled, restored, undone, whole = look("La funci�n ser� m�s r�pida", model)
    assert garbled and not whole and undone == 0 and "�" in restored


def test_sound_texts_stay(model):
    for t in [*SOUND, PLAIN, *RARE, "", "a", "`�` is expected"]:
        assert look(t, model)[:2] == (False, t)


def test_segments_touch_few_sound_runs_and_all_garbled_texts(model):
    flagged = sum(len(r) for r, _ in M.suspicious_runs(SOUND * 3, model))
    assert flagged <= 0.1 * 3 * sum(len(M.all_runs(t)) for t in SOUND)
    bad = [wrongly(t, "utf-8", "cp1252") for t in SOUND]
    assert all(r for r, _ in M.suspicious_runs(bad, model))


def test_one_pair_scores_as_many_do(model):
    for two in ("né", "Ã©", "ab", "\n¿", "的型"):
        assert abs(model.pair(two) - float(model.scores(M.points_of(two))[0])) < 1e-12


def test_maximal_segments_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = rng.integers(-3, 4, rng.integers(1, 12)).astype(float)
        got = M.maximal_segments(x)
        best = max((x[i:j].sum() for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=0)
        assert (max((x[a:b].sum() for a, b in got), default=0) == best) if best > 0 else not got
        assert all(a < b and x[a:b].sum() > 0 for a, b in got) and all(p[1] <= q[0] for p, q in zip(got, got[1:]))


def test_table(spark):
    rows = [(i, t) for i, t in enumerate(SOUND * 5 + [PLAIN] * 50)] + [(900, None), (901, ""), (902, wrongly(SOUND[0], "utf-8", "cp1252")), (902, wrongly(SOUND[0], "utf-8", "cp1252")), (None, "a�b")]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, restored int")
    got = [tuple(r)[:2] for r in M.garbled_texts(df).collect()]
    assert sorted(got, key=str) == sorted([(902, SOUND[0])] * 2 + [(None, "a�b")], key=str)
    assert M.garbled_texts(df.limit(0)).count() == 0


@pytest.mark.parametrize("i", [0, 1, 2, 3, 4])
@pytest.mark.parametrize("varied", [False, True])
def test_a_garbled_text_that_fills_the_table_is_found(spark, i, varied):
    bad = wrongly(SOUND[i], "utf-8", "cp1252")
    rows = [(k, t) for k, t in enumerate(SOUND * 5 + [PLAIN] * 50)] + [(1000 + k, f"{bad} {k}" if varied else bad) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in M.garbled_texts(df).collect()) == list(range(1000, 4000))


def test_runs_that_read_as_utf8_by_chance_stay(spark):
    rows = [(k, t) for k, t in enumerate(SOUND * 20 + ["Le « CAFÉ» est fermé.", "DAS IST KEIN Spaß”, sagte er.", "« validé\u00a0» et « passé\u00a0»"])]
    assert M.garbled_texts(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
