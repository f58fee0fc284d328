import pytest

from tessella.llm.sentences import corpus_evidence, sentence_spans, sentences

CASES = [
    ("It was sent to Prof. Lovik, St. Brithu Road. The desk opens at 7 a.m. and shuts at 9 p.m. See No. 6 of the list, e.g. the entry.", 3),
    ("Dr. Oldta paid Rs. 22.50 incl. tax, i.e. about 3% more. Speed was 5.5 GB.", 2),
    ('"Where is my refund?" asked Kazan, but nobody knew. The note read ‘closed. No refund.’ and carried a stamp.', 2),
    ('The agent wrote: "It is on hold. Call again after 15 August." Thank you!', 2),
    ("Dial *9# (free of charge!) to record it. (See clause 7 for more.) Is it late?! eSIM profiles stay.", 4),
    ("Well... the swap was sent after all. J. K. Drota signed it for Anvil Business M. Customers wait.", 3),
    ("Die Sperre war am 25. März noch offen. „Bitte warten Sie. Die Karte läuft“, sagte Quaren. Daten, SMS usw. Und mehr.", 4),
    ("« Patientez. La recharge est en cours », a dit Mulo. Merci d'avoir attendu, Kalo ! M. Shove et Mme Brita partagent.", 3),
    ("¿Por qué? El Sr. Dalta y la Sra. Brita comparten. Véase la pág. 18. ¡Gracias!", 4),
    ("客服说：“请稍等。充值正在处理。”版本2.1修正了页面（见第8.4节。）。你好……但是没有成功。到账了吗？！请勿提交！", 5),
    ("担当者は「お待ちください。確認します。」と答えました。使えますか？", 2),
    ("डॉ. शोनेम ने रु. 62.50 दिए। क्या योजना चालू है? पन्ना बदला गया है| धन्यवाद!", 4),
    ("ความเร็วจะลดลงหลังใช้ครบ 55 GB กรุณาทำการเปลี่ยนซิมก่อนวันที่ 76 เดือนหน้า ขอบคุณ", 3),
    ('قالت الموظفة: "انتظر. الفاتورة قيد المراجعة." هل تعمل؟ شكرا لك!', 3),
    ("no pack is sent while the line is late ! the desk refused 9% of all requests... thank you for waiting!! the store closed.", 4),
    ("The cable failed.Each modem reports.Yes, again.", 3),
    ("Dear Dalta,\n\nThe core router in Silaold ran without a backup until 5\nSeptember. It was sent to Prof.\nNemtagar, a desk that has many forms.\n\nRegards,\nNem Loqua", 5),
    ("Heading without mark\n\n1. First point. More here.\n2) Second point\n- third", 5),
    ("Agent: Hello there.\nCustomer: Thank you", 2),
]


@pytest.mark.parametrize("text,n", CASES)
def test_counts(text, n):
    spans = sentence_spans(text)
    parts = [text[a:b] for a, b in spans]
    assert len(parts) == n, parts
    assert all(p == p.strip() and p for p in parts)
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
    assert "".join(text.split()) == "".join("".join(parts).split())  # nothing is lost


def test_log_lines_and_blanks():
    log = '2026-01-10T21:54:45Z\tWARN  a.b[1]: late. code=1\n    at x.check(y.py:8)\n{"at": "x. Y"}'
    assert len(sentence_spans(log, "log")) == len(sentence_spans(log, None)) == 3
    assert sentence_spans(None) == sentence_spans("") == sentence_spans(" \n　") == []


def test_corpus_evidence(spark):
    texts = [f"We met Zq. {n} today. The zones of the city open today." for n in ("Anna", "Bert", "Cora", "Dora", "Emil")] * 10 + ["Visit Yahoo! is it open", "Yahoo! has it", "Yahoo! was here"] * 5 + [None, ""]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "id bigint, text string, kind string")
    frame = corpus_evidence(docs)
    evidence = {r["word"]: r["kind"] for r in frame.collect()}
    assert evidence.get("zq") == "never" and evidence.get("yahoo") == "bang"
    assert "today" not in evidence
    got = sentences(docs, frame).filter("id = 0").collect()
    assert len(got) == 2
    assert sentences(docs.limit(0)).count() == 0


def test_very_long_text():
    text = "The line was closed by Dr. Mulo. " * 20000
    assert len(sentence_spans(text)) == 20000
    assert len(sentence_spans("word " * 100000)) == 1
    assert len(sentence_spans("(" * 3000 + "a. B")) >= 1


@pytest.mark.parametrize("text,n", [
    # a word by its other uses, although the list has it
    ("The sun, it seems, was out. They sat under the sun. Visitors came.", 3),
    # abbreviations by their other uses: other scripts, longer words
    ("Дом на ул. садовой закрыт. Она пошла на ул. Садовую потом.", 2),
    ("See the appdx. for it and the appdx. on fees. The appdx. Kalo wrote is new. It is open. They paid. We know.", 5),
    # what follows an abbreviation: a common word of this text or not
    ("Take zq. five or zq. ten. All of them hold zq. Ten is the most.", 3),
    # a single letter before a name of this text, and before a common word
    ("We met Drota at the desk of the shop and then went on to the other place. It was Anvil J. Drota who signed.", 2),
    ("The tablets hold vitamin C. Tablets are sold here, and tablets last.", 2),
])
def test_the_text_decides_first(text, n):
    parts = [text[a:b] for a, b in sentence_spans(text)]
    assert len(parts) == n, parts


def test_the_text_decides_before_the_corpus():
    assert len(sentence_spans("We pay the fee, as agreed. It is the fee. Anna knows.", None, {"fee": "never"})) == 3
    assert len(sentence_spans("It is the fee. Anna knows.", None, {"fee": "never"})) == 1


def test_marked_texts():
    """Sentences marked by hand in 24 languages: at least 95 % found, and 95 % of those found right."""
    from tests.llm.marked_sentences import MARKED

    every = found = both = 0
    for _, joiner, parts in MARKED:
        want, at = set(), 0
        for part in parts:
            want.add((at, at + len(part)))
            at += len(part) + len(joiner)
        got = set(sentence_spans(joiner.join(parts)))
        every, found, both = every + len(want), found + len(got), both + len(want & got)
    assert every >= 200
    assert both >= 0.95 * every and both >= 0.95 * found


@pytest.mark.parametrize("text,n", [
    ("The answer is no. Please call again later.", 2), ("I sat. Then the agent came back to me.", 2), ("The new ref. This was wrong.", 2),
    ("I saw the sun. It was bright.", 2), ("We liked the sun in May. I saw the sun. It was bright.", 3), ("He wears a fig. It is green.", 2),
    ("It is no. 7 on the list, see fig. 3 there.", 1), ("Open on Mon. 5 May. Then closed.", 2), ("It took 5 ms. Then it stopped.", 2),
])
def test_listed_words_count_in_their_place_only(text, n):
    assert len(sentence_spans(text)) == n


def test_evidence_reaches_every_text(spark):
    """Words of the corpus come to the texts by a join, for copies and null ids too."""
    texts = ["It is the krx. Anna knows.", "It is the krx. Anna knows.", "", None]
    docs = spark.createDataFrame([(None, t, None) for t in texts], "id bigint, text string, kind string")
    evidence = spark.createDataFrame([("krx", "never"), ("other", "never")], "word string, kind string")
    assert sentences(docs, evidence).count() == 2
    assert sentences(docs, evidence.limit(0)).count() == 4
