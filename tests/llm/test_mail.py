import datetime

import pytest
from pyspark.sql import functions as F

from blockmill.llm import mail

BLOCKS = "block_id bigint, upload_id bigint, block_no int, text string, anchor_kind string, loaded_at timestamp, why string"
HEADS = "upload_id bigint, message_id string, in_reply_to string, subject string, sender string, sent_at timestamp"
DAY = datetime.datetime(2024, 3, 1)
ANN, BOB = "Ann Example <ann.example@north-freight.example>", "Bob Sample <bob.sample@south-tools.example>"

MAILS = {
    1: (ANN, None, ["Hi Bob,", "The open hinge verifies the gateway before noon. Every rack in the hall holds 40 units.\nThe final crane waits outside.", "Best regards,\nAnn Example", "This note is confidential and meant for the addressee alone.\nIf it reached you by mistake, erase it."]),
    2: (BOB, 1, ["Hi Ann,", "Agreed, the crane moves on Friday.", "PS: bring the keys.", "Cheers,\nBob", "On 1 Mar 2024, Ann Example <ann.example@north-freight.example>\nwrote:\n> Hi Bob,\n> The final crane waits outside.", "No, it waits inside.", "> Best regards,\n> Ann Example"]),
    3: (ANN, 2, ["Thanks.", "-- that is, unless the hall closes first --\nTo: or not to: leave the crane here.", "The open hinge verifies the gateway before noon. Every rack in the hall\nholds 40 units.", "Best regards,\nAnn Example", "This note is confidential and meant for the addressee alone.\nIf it reached you by mistake, erase it."]),
    4: (BOB, 3, ["fyi, crane", "Sent from my handset", "Begin forwarded message:\nFrom: Ann Example <ann.example@north-freight.example>\nDate: 2/3/2024 10:00", "Thanks.", "Whatever else was there."]),
}
#: The lines that are not new, as (block_no, line).
GONE = {
    1: {(3, 1), (3, 2), (4, 1), (4, 2)},
    2: {(4, 1), (4, 2), (5, 1), (5, 2), (5, 3), (5, 4), (7, 1), (7, 2)},
    3: {(3, 1), (3, 2), (4, 1), (4, 2), (5, 1), (5, 2)},
    4: {(2, 1), (3, 1), (3, 2), (3, 3), (4, 1), (5, 1)},
}


def tables(spark, mails=MAILS, extra=()):
    blocks = [(u * 100 + n, u, n, t, "Email", DAY, "clash") for u, (_, _, texts) in mails.items() for n, t in enumerate(texts, 1)]
    heads = [(u, f"<{u}>", r and f"<{r}>", "Re: crane" if u > 1 else "crane", who, DAY + datetime.timedelta(days=u)) for u, (who, r, _) in mails.items()]
    return spark.createDataFrame([*blocks, *extra], BLOCKS), spark.createDataFrame(heads, HEADS)


def test_lines_not_newly_written(spark):
    extra = [(101, 1, 1, "Hi Bob,", "Email", DAY + datetime.timedelta(days=1), ""), (900, 9, 1, None, "Email", None, ""), (901, 9, 2, " \n", "Email", None, ""), (902, None, 1, "Just text.", "Email", None, ""), (903, 9, 3, "> q", "Section", None, "")]
    blocks, heads = tables(spark, extra=extra)
    got = {u: set() for u in MAILS}
    for r in mail.marked_lines(blocks, heads).collect():
        got[r.block_id // 100].add((r.block_id % 100, r.line_no))
    assert got == GONE


def test_new_texts(spark):
    blocks, heads = tables(spark)
    got = {r.upload_id: r.text for r in mail.new_texts(blocks, heads).collect()}
    assert got[2] == "Hi Ann,\n\nAgreed, the crane moves on Friday.\n\nPS: bring the keys.\n\nNo, it waits inside."
    assert got[4] == "fyi, crane"


def test_empty_tables(spark):
    blocks, heads = tables(spark)
    assert mail.marked_lines(blocks.where("false"), heads.where("false")).count() == 0
    assert mail.marked_lines(blocks, heads.where("false")).count() > 0


def lines_of(df):
    return {(r.block_id, r.line_no) for r in df.collect()}


def test_a_large_thread_is_dealt_into_slices(spark, monkeypatch):
    said = [f"The crane number {n} verifies the northern gateway before noon." for n in range(40)]
    mails = {n + 1: (BOB if n % 2 else ANN, n or None, ["Hello,", said[n], *([said[n // 2]] if n > 1 else [])]) for n in range(40)}
    blocks, heads = tables(spark, mails)
    whole = lines_of(mail.marked_lines(blocks, heads))
    assert whole == {((n + 1) * 100 + 3, 1) for n in range(2, 40)}
    monkeypatch.setattr(mail, "SLICE_CHARS", 600)
    assert lines_of(mail.marked_lines(blocks, heads)) == whole


def test_slices_find_what_the_whole_thread_finds(spark, monkeypatch):
    import random

    rng = random.Random(5)
    words = ["ox", "crane", "gate", "noon", "Ähre", "no", "I", "wheel", "northern", "42", "ride,", "halls", "東京"]
    sentence = lambda: " ".join(rng.choices(words, k=rng.randint(1, 9))).capitalize() + rng.choice(".!?")
    said, mails = [], {}
    for u in range(1, 31):
        texts = []
        for _ in range(4):
            old = " ".join(rng.sample(said, min(len(said), rng.randint(0, 3))))
            own = [sentence() for _ in range(2)]
            said += own
            texts.append(rng.choice([f"{own[0]} {old} {own[1]}", f"{old}\n{own[0]}\n{own[1]}", f"| {old}\n| {own[1]}"]))
        mails[u] = (ANN if u % 2 else BOB, u - 1 or None, texts)
    blocks, heads = tables(spark, mails)
    whole = lines_of(mail.marked_lines(blocks, heads))
    monkeypatch.setattr(mail, "SLICE_CHARS", 900)
    assert len(whole) > 30 and lines_of(mail.marked_lines(blocks, heads)) == whole


def test_every_match_shares_a_route():
    texts = ["x", "Ja.", "the crane", "a sentence of some thirty chars.", "A sentence that is much longer than a single window of all its grams, as most are."]
    for t in texts:
        assert mail.route_of(t) in mail.routes_of(t)
        assert mail.route_of(t) in mail.routes_of(f"# lead-in: {t} and more (or not)")


def test_history_in_any_place_and_an_answer_below_a_head(spark):
    first = ["Hi Bob,", "The final crane waits outside. The open hinge verifies the gateway."]
    mails = {
        1: (ANN, None, first),
        2: (BOB, 1, ["Indeed: The final crane waits outside. The open hinge verifies the gateway.", "So be it."]),
        3: (BOB, 1, ["fyi", "From: Ann Example <ann.example@north-freight.example>\nDate: 2/3/2024 10:00", *first, "I would rather have it inside."]),
        4: (BOB, 1, ["fyi", "From: Cid <cid@elsewhere.example>\nDate: 2/3/2024 10:00", "Not in any table."]),
    }
    blocks, heads = tables(spark, mails)
    assert lines_of(mail.marked_lines(blocks, heads)) == {(201, 1), (302, 1), (302, 2), (303, 1), (304, 1), (402, 1), (402, 2), (403, 1)}


def test_one_subject_does_not_join_mails_that_answer_nothing(spark):
    rows = [(n, f"<{n}>", None, "hello", ANN, DAY) for n in range(4)] + [(9, "<9>", "<gone>", "Re: other", BOB, DAY), (10, "<10>", None, "Other", BOB, DAY)]
    got = {r.upload_id: r.thread for r in mail.mail_threads(spark.createDataFrame(rows, HEADS)).collect()}
    assert len({got[n] for n in range(4)}) == 4 and got[9] == got[10]


def test_notes_that_recur_over_senders_close_their_mails(spark):
    note = "Words sent by {} bind nobody at all, registered in {} as 45{}."
    mails = {}
    for n, (name, place) in enumerate((("Ada Miller", "Oxhall"), ("Cleo Baker", "Oxhall"), ("Dan Cooper", "Oxhall"), ("Eve Turner", "Oxhall"))):
        mails[n + 1] = (f"{name} <{name.split()[0].lower()}@firm-{'abcd'[n]}.example>", None, ["Hi,", ["The crane moves to the hall on Friday.", "Nobody greased a wheel today, sadly.", "Two gates stay shut until the rain ends.", "We ordered ropes and paint for spring."][n], note.format(f"Firm {'ABCD'[n]}", place, n)])
    blocks, heads = tables(spark, mails)
    heads = heads.withColumn("subject", F.col("message_id"))
    assert lines_of(mail.marked_lines(blocks, heads)) == {(u * 100 + 3, 1) for u in mails}


def test_a_closing_block_above_passed_on_text_of_any_length(spark):
    motto, firm = "Turn the wheels of the northern halls with care", "North freight keeps every wheel of the halls in motion"
    mails = []
    for t in (0, 10):
        said = [f"In thread {t} the crane number {n} verifies the northern gateway before noon." for n in range(9)]
        mails.append((t + 1, None, f"gate {t}", BOB, ["Hi Ann,", *said, firm]))
        mails.append((t + 2, t + 1, f"Re: gate {t}", ANN, ["Hi Bob,", f"Crane {t} is greased now.", motto, *said]))
        mails.append((t + 3, t + 2, f"Re: gate {t}", ANN, ["Hi Bob,", f"Crane {t} is painted now.", f"So long then\n{firm}", *said]))
    blocks = [(u * 100 + n, u, n, x, "Email", DAY, "") for u, _, _, _, texts in mails for n, x in enumerate(texts, 1)]
    heads = [(u, f"<{u}>", r and f"<{r}>", subject, who, DAY + datetime.timedelta(days=u)) for u, r, subject, who, _ in mails]
    gone = {(r.block_id, r.line_no) for r in mail.marked_lines(spark.createDataFrame(blocks, BLOCKS), spark.createDataFrame(heads, HEADS)).collect()}
    for u in (2, 12):
        assert {(b, k) for b, k in gone if b // 100 == u} == {(u * 100 + n, 1) for n in range(3, 13)}
    for u in (3, 13):
        assert {(b, k) for b, k in gone if b // 100 == u} == {(u * 100 + n, 1) for n in range(3, 13)} | {(u * 100 + 3, 2)}


def own(text, sender=ANN):
    m = mail.read_mail([(1, 1, text)], sender)
    mail.mark_structure(m)
    gone = {(x[0], x[1]) for x in mail._seen(m, mail.Scan(m, (0, 0)), 1, 1, sender)}
    return [x.text for x in m.lines if (x.block_id, x.number) not in gone]


@pytest.mark.parametrize(
    "intro",
    [
        "Am 01.03.2024 10:00 schrieb Bob Sample:",
        "Le 1/3/2024 10:00, Bob Sample <bob.sample@south-tools.example> a écrit :",
        "El 1/3/2024 10:00, Bob Sample escribió:",
        "[2024-03-01 10:00] Bob Sample:",
        "* Bob Sample (bob.sample@south-tools.example) [Fri, Mar 1, 2024\nat 10:00]:",
        "Bob Sample wrote on 1 Mar 2024:",
    ],
)
@pytest.mark.parametrize("mark", ["> ", ">", "BS> ", "| ", ": ", "» "])
def test_introductions_and_marks(intro, mark):
    assert own(f"{intro}\n{mark}old text here\n{mark}more old text\nA new line.") == ["A new line."]


def test_lines_that_only_look_like_marks():
    for line in ("-> next step is the outline.", "From: Dunhollow the road is closed, so plan for 4 more hours.", "Bob wrote: keep the bridge, and I agree with that.", "With regards to the lease, nothing is settled."):
        assert own(f"Some text first.\n{line}") == ["Some text first.", line]
