import pytest

from blockmill.llm import encodings

CLEAN = [
    "Die Größe der Straße wird später geprüft, während Schlüssel und Gerät möglich bleiben. Müssen höher geändert täglich.",
    "Le contrôle général a été vérifié, déjà préparé à l’hôtel où la façade élevée était. Réunion première équipe août.",
    "A reunião próxima não é possível, também você avaliação de maçã e órgão português. Ação edição coração três mês.",
    "Заказ на склад: поставка завтра утром, договор и отчёт после проверки. Город, дорога, работа, система, вода.",
    "Η παραγγελία του πελάτη είναι στο τραπέζι, κάθε εβδομάδα. Σύστημα και αποθήκη, πάντα το πρωί.",
    "会議は来週です。資料を確認してください。モーターのデータを更新しました。",
    "“Quoted” text — it’s 45° and €30… ‘fine’.",
    "Zażółć gęślą jaźń, książka i dostęp do źródła. Większy tydzień, miejsce, łódź.",
]
GARBLED = [
    ("Die Größe der Straße wird später geprüft".encode().decode("cp1252"), "Die Größe der Straße wird später geprüft"),
    ("vérifié déjà préparé".encode().decode("latin-1"), "vérifié déjà préparé"),
    ("a reunião próxima".encode().decode("cp1252").encode().decode("cp1252"), "a reunião próxima"),
    ("Straße und Größe".encode().decode("mac_roman"), "Straße und Größe"),
    ("поставка завтра".encode("cp1251").decode("cp1252"), "поставка завтра"),
    ("поставка завтра".encode("koi8_r").decode("cp1251"), "поставка завтра"),
    ("会議は来週です。資料を確認".encode("cp932").decode("latin-1"), "会議は来週です。資料を確認"),
    ("später geprüft Größe".encode("cp1252").decode("cp850"), "später geprüft Größe"),
    ("it&#226;&#128;&#153;s here", "it’s here"),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [("clean", n, t, 0) for n, t in enumerate(CLEAN * 30)] + [("bad", n, t, 0) for n, (t, _) in enumerate(GARBLED)]
    rows += [("lost", 0, "M�dchen", 0), ("none", 0, None, 0), ("none", 1, "", 0), ("none", 2, "plain ascii", 0), ("none", 3, "AT&#233;T &#65;", 0), ("bad", 0, GARBLED[0][0], 0)]
    df = spark.createDataFrame(rows, "rec string, rec_id bigint, text string, restored int")
    return {(r.rec, r.rec_id): r for r in encodings.find_garbled(df).collect()}


def test_clean_text_of_any_language_is_no_case(found):
    assert not [k for k in found if k[0] in ("clean", "none")]


@pytest.mark.parametrize("n", range(len(GARBLED)))
def test_garbled_text_is_found_and_restored(found, n):
    assert ("bad", n) in found
    assert found["bad", n].restored == GARBLED[n][1]


def test_lost_characters_are_cases(found):
    assert found["lost", 0].lost == 1 and found["lost", 0].restored == "M�dchen"


def test_a_garbled_text_in_very_many_rows_is_found(spark):
    bad = "später geprüft Größe".encode("cp1252").decode("cp850")
    rows = [("clean", n, f"{n} {CLEAN[0]}") for n in range(300)] + [("bad", n, bad) for n in range(1500)]
    got = encodings.find_garbled(spark.createDataFrame(rows, "rec string, rec_id bigint, text string")).collect()
    assert {(r.rec, r.rec_id) for r in got} == {("bad", n) for n in range(1500)}
    assert {r.restored for r in got} == {"später geprüft Größe"}


def test_a_language_that_stands_nowhere_intact_is_found(spark):
    texts = ["Заказ на склад: поставка завтра утром, договор и отчёт после проверки.", "Η παραγγελία του πελάτη είναι στο τραπέζι κάθε εβδομάδα."]
    rows = [("clean", n, t) for n, t in enumerate(x for x in CLEAN if not any("Ͱ" <= c <= "ӿ" for c in x))]
    rows += [("bad", n, f"{n} {texts[0]}".encode("cp1251").decode("cp1252")) for n in range(50)]
    rows += [("greek", n, f"{n} {texts[1]}".encode("cp1253").decode("cp1252")) for n in range(50)]
    got = {(r.rec, r.rec_id): r.restored for r in encodings.find_garbled(spark.createDataFrame(rows, "rec string, rec_id bigint, text string")).collect()}
    assert got == {("bad", n): f"{n} {texts[0]}" for n in range(50)} | {("greek", n): f"{n} {texts[1]}" for n in range(50)}


def test_tables_signs_and_rare_scripts_are_of_no_other_script():
    for text in ("╔═══╗ ║ ╚═══╝ ╠═══╣ ═══ ════ ├──┼──┤ └──┘ ┌──┐", "→→→ •••• ★★★ ∑≤∞ ±²³ 🔥🔥🔥", "ÄÖÜ äöüß éèê", "Դուրս եկավ տուն", "שלום עולם טוב", "ǃÀó ưở đã được nướng", *CLEAN):
        assert encodings._script_readings(list(dict.fromkeys(encodings.words_of(text)))) == {}


def test_automaton_takes_maximal_spans_only():
    assert encodings._decode_spans("x" + "é".encode().decode("cp1252") + "ç", "cp1252") == "xéç"
    assert encodings._decode_spans("façade Ã", "cp1252") is None


def test_empty_table_and_very_long_words(spark):
    empty = spark.createDataFrame([], "rec string, rec_id bigint, text string")
    assert encodings.find_garbled(empty).count() == 0
    long = spark.createDataFrame([("a", 1, "é" * 20000 + " " + "ok" * 20000)], "rec string, rec_id bigint, text string")
    assert encodings.find_garbled(long).count() == 0


def test_parts_of_overlong_words_cut_no_span(spark):
    bad = "é".encode().decode("cp1252")
    for before in (4095, 4096, 4094):
        word = "a" * before + bad * 3 + "b" * 9000 + bad
        parts = encodings.parts_of(word)
        assert "".join(parts) == word and sum(p.count(bad) for p in parts) == 4
        assert "".join(encodings._decode_spans(p, "cp1252") or p for p in parts) == encodings._decode_spans(word, "cp1252")
    assert encodings.parts_of("漢" * 9000) == ["漢" * 9000]
    rows = [("x", 1, "a" * 4095 + bad), ("x", 2, "語" * 80 + " ok"), *(("clean", n, t) for n, t in enumerate(CLEAN * 3))]
    df = spark.createDataFrame(rows, "rec string, rec_id bigint, text string")
    assert [r.restored for r in encodings.find_garbled(df).collect()] == ["a" * 4095 + "é"]


def test_known_words_are_those_beyond_chance():
    model = encodings.np.zeros((2, 2 * encodings.SLOTS + 1), encodings.np.float32)
    model[:, :] = 1000.0
    assert encodings.Reader(model)._known(["größe"]).max() == 0
    for slot in encodings._word_slots(["größe"]):
        model[:, slot] = 5000.0
    assert encodings.Reader(model)._known(["größe"]).min() > 0
