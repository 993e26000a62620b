import pytest
from pyspark.sql import functions as F

from loomspark.llm.defects import asked_languages, copied_share, COPY_SHARE, is_empty, is_refusal, label_pairs, question_answer_pairs
from loomspark.llm.lang import train_languages
from loomspark.llm.truncation import PAD, _final_shape, _filters, ending_of, final_states, stripped, truncated_values

MARK = "<|channel>thought\n<channel|>"
SAID = {
    "en": ["The account returned to the kitchen tiles in July because an earlier order never came.", "They compare the night trains with the ferry and then wait, mostly in the morning."],
    "de": ["Das Konto kehrte im Juli zu den Fliesen zurück, weil eine frühere Bestellung nie ankam.", "Vor der Wahl werden die Nachtzüge mit der Fähre verglichen, meistens am Morgen."],
    "ja": ["以前の注文がうまくいかなかったので、七月に台所のタイルへ戻りました。", "決める前に夜行列車とフェリーを比べ、たいてい朝に見ています。"],
}


@pytest.mark.parametrize("answer", [None, "", "  \t", "​", "{}", "```json\n```", MARK, MARK + "\n", "<turn|>\n", "```json\n{}\n```", " {} "])
def test_empty(answer):
    assert is_empty(answer)


@pytest.mark.parametrize("answer", ["No change.", "Herbst", "冬", "0", '{"season": "summer"}', "no", "- a", "None", "-", "n/a"])
def test_not_empty(answer):
    assert not is_empty(answer)


@pytest.mark.parametrize("answer", ["I'm sorry, but I can't help with this.", MARK + "Leider gilt: diese Anfrage muss ich ablehnen.", "Je préfère ne pas me prononcer.", "Debo rechazar esta solicitud.", "申し訳ありませんが、お手伝いできません。", '{"interests": [], "summary": "I have to decline."}'])
def test_refusals(answer):
    assert is_refusal(answer)


@pytest.mark.parametrize("answer", ["They were unable to find it in stock and turned to tents.", "I can't see any purchase after May, so the weight stays moderate.", "Unfortunately, night trains lost ground.", "No change.", "Ich kann nach August keinen Kauf erkennen.", "2月以降、新しいことはありません。"])
def test_no_refusals(answer):
    assert not is_refusal(answer)


#: Written from what refusals say, not from the patterns.
REFUSING = [
    'I am unable to process that.',
    "I'm afraid I won't be able to help you with it.",
    'Regrettably, I must pass on this one and decline.',
    'This request cannot be answered.',
    'It goes against my guidelines, so I will leave it.',
    'I would prefer not to write about this person.',
    "We do not answer questions of this kind; I'm not permitted to.",
    'That falls outside my remit.',
    'Sorry, but I cannot complete this task.',
    'My instructions do not allow it.',
    'Das übersteigt meine Befugnisse.',
    'Dazu kann ich Ihnen leider keine Auskunft geben.',
    'Ich bin nicht befugt, solche Profile zu erstellen.',
    'Diese Anfrage kann nicht bearbeitet werden.',
    'Ich enthalte mich einer Antwort.',
    'Es ist mir nicht gestattet, das zu tun.',
    'Darauf möchte ich nicht eingehen.',
    "Je m'abstiens de répondre.",
    'Désolé, je ne suis pas en mesure de traiter cette demande.',
    'Cela dépasse mes attributions.',
    "Il m'est malheureusement impossible de le faire.",
    'Je ne souhaite pas répondre à cette question.',
    'Votre demande ne peut pas être satisfaite.',
    'Lo siento, no puedo procesar esta petición.',
    'Me abstengo de contestar.',
    'Eso va en contra de mis normas.',
    'No estoy autorizada a hacerlo.',
    'Esta solicitud no puede ser atendida.',
    '申し訳ございませんが、この依頼には応じられません。',
    'その件については回答を控えます。',
    'お受けできません。',
    '権限がありません。',
    'Mi dispiace, non posso aiutarti.',
    'Preferisco non rispondere.',
    'Desculpe, não posso ajudar com isso.',
    'Recuso-me a responder.',
    'Het spijt me, daar kan ik niet bij helpen.',
    '抱歉，我无法回答这个问题。',
    '죄송하지만 도와드릴 수 없습니다.',
    'Извините, я не могу помочь с этим.',
]
NOT_REFUSING = [
    "I can't see any purchase after May, so the weight stays moderate.",
    'I cannot say for certain whether the kitchen matters more.',
    'They declined two offers in June and kept one.',
    'The account refused cookies and left my list alone.',
    'Nothing changed since the last profile.',
    'I will describe the interests first, then the weights.',
    "I'm not sure, but gardening seems likely.",
    'The shop could not deliver, so they cancelled the order.',
    'Probably not; the visits stopped in March.',
    'Their request was processed within two days.',
    'Ich kann nach August keinen Kauf erkennen.',
    'Ich bin nicht sicher, ob das Interesse anhält.',
    'Die Bestellung konnte nicht geliefert werden.',
    'Sie lehnte zwei Angebote ab und behielt eines.',
    'Vermutlich kein Interesse an Versicherungen.',
    'Je ne vois aucun achat après mai.',
    "Je ne sais pas si l'intérêt est durable.",
    'Elle a refusé deux offres en juin.',
    'La demande a été traitée en deux jours.',
    'No veo ninguna compra después de mayo.',
    'No estoy seguro de que le interese el jardín.',
    'La cuenta rechazó dos ofertas.',
    'Probablemente no; las visitas cesaron en marzo.',
    '2月以降、新しいことはありません。',
    '購入は確認できません。',
    '関心は高くありません。',
    'Non vedo acquisti dopo maggio.',
    'Não vejo compras depois de maio.',
    'Ik zie geen aankopen na mei.',
    '我认为他们喜欢园艺。',
]


def test_recall_and_precision_of_refusals():
    found = [x for x in REFUSING if is_refusal(x)]
    false = [x for x in NOT_REFUSING if is_refusal(x)]
    assert len(found) >= 0.95 * len(REFUSING) and not false


@pytest.mark.parametrize("filler", [0, 300, 419, 421, 600, 5000])
def test_refusals_of_any_length(filler):
    why = ("The record names a person and asks for a judgement. " * (filler // 50 + 1))[:filler]
    assert is_refusal("I can't help with this request. " + why) and is_refusal("Das übersteigt meine Befugnisse. " + why)


@pytest.mark.parametrize("n", [1, 199, 201, 1999, 2001, 50_000])
def test_emptiness_of_any_length(n):
    assert is_empty("\u200b" * n) and is_empty("{" + " " * n + "}") and is_empty("```json\n" + "\n" * n + "```") and not is_empty("{" + " " * n) and not is_empty("\u200b" * n + "x")


def test_copies_of_any_length():
    q = "What changed since the last profile? " + " ".join(f"visit {i} shop{i * 7 % 13} at {i}:30;" for i in range(30))
    intro = "You asked me to look at the following activity and to tell you what I make of it, so here it is again in full, word for word: "
    assert len(intro) > 80 and copied_share(q, intro + q) <= COPY_SHARE
    assert copied_share(q, q + "\n" + q) <= COPY_SHARE  # 2 times its question
    assert copied_share(q, q[: int(0.7 * len(q))]) <= COPY_SHARE and copied_share(q, q[: int(0.2 * len(q))]) == 1.0
    assert copied_share(q, q + " " + " ".join(f"word{i * i % 977}" for i in range(200))) > COPY_SHARE


def test_languages_of_many_labels(spark):
    rows = [(f"l{i}", f"label{i} text") for i in range(400)] + [("en", SAID["en"][0])] * 60 + [("de", SAID["de"][0])] * 60
    model = train_languages(spark.createDataFrame(rows, "lang string, text string"), "lang", "text", 0.05)
    assert model.languages == ["de", "en"] and model.detect([SAID["de"][0]])[0] == ["de"]


def test_language_asked_for_in_the_middle():
    data = " ".join(f"visit {i} to a shop of tents." for i in range(40))
    assert asked_languages("Describe this person. " + data + "\nPlease answer in German.\n" + data) == {"de"}
    assert asked_languages(data + " They read novels in French at night. " + data) == set()
    assert asked_languages(data + "。日本語で答えてください。" + data) == {"ja"}


def test_long_refusals():
    why = " ".join(f"The record {i} names a person and asks for a judgement." for i in range(40))
    assert is_refusal("I'm sorry, but I can't help with this. " + why)
    assert is_refusal("Thank you for this question, which is a thoughtful one. " * 5 + "I have to decline this request, as it is not mine to judge.")
    assert is_refusal('{"interests": [' + ", ".join(f'"hobby number {i}"' for i in range(120)) + '], "summary": "I have to decline."}')
    assert not is_refusal(why + " I can't help with medical questions.")
    assert not is_refusal("They say this:\n> I can't help with this.\n" + why)
    assert not is_refusal(why)


def test_copies():
    q = "What changed since the last profile? " + " ".join(f"visit {i} shop{i * 7 % 13} at {i}:30;" for i in range(20))
    assert copied_share(q, q) <= COPY_SHARE and copied_share(q, "You wrote: " + q.upper()) <= COPY_SHARE
    assert copied_share(q, q.replace("visit 7", "call 8").replace("shop1", "shap1")) <= COPY_SHARE
    assert copied_share(q, q[:60]) == 1.0  # one quoted line isn't a copy
    assert copied_share(q, "> " + q[:60] + "\n\n" + " ".join(SAID["en"]) * 3) > COPY_SHARE
    short = "How sure are you about raised beds?"
    assert copied_share(short, "Here is the activity again: " + short) <= COPY_SHARE and copied_share(short, short[:-1]) <= COPY_SHARE
    assert copied_share(short, f"> {short}\n\nQuite sure, they ask every week.") > COPY_SHARE and copied_share(short, "Same as before: raised beds.") > COPY_SHARE
    assert copied_share("x", "y") > COPY_SHARE and copied_share("", "abc") > COPY_SHARE


def test_asked_languages():
    assert asked_languages("Describe this. Please answer in German.") == {"de"}
    assert asked_languages("説明してください。ドイツ語で答えてください。") == {"de"}
    assert asked_languages("Merci de répondre en espagnol.") == {"es"} and asked_languages("What is new?") == set()


@pytest.mark.parametrize("text, want", [('{"a": 1', 1), ('{"a": "b', 2), ('{"a": 1}', 0), ("plain", 0), ('[{"a": [1]}]\nSay', 0), ('[{"a": "}"}, {"b"', 1), ("", 0), ("a { stands alone, they say", 0), ("a { stands alone.", 0), ('{"a": "say \\"x', 2), ("[2026-01-02 13:4", 0), ("[2026-01-02] {", 1), ("[2026-01-02] x", 0)])
def test_states(text, want):
    assert final_states(["x" * 70_000, text, '{"other": [', text]).tolist() == [0, want, 1, want]


def test_endings():
    assert [ending_of(stripped(t)) for t in ["a ", "a\n", "a!", "a sentence.", "am 3.", "a", "", "a <turn|>\n", "(5 Min.", "a \ufffd"]] == ["open", "open", "mark", "mark", "stop", "open", "nothing", "open", "stop", "half"]
    assert ending_of('{"a": "They wait.', True) == "open"


def test_the_shape_of_an_end_is_long_enough():
    assert len(_final_shape("word " * 30 + "1234567890" * 400)) >= PAD and len(_final_shape("Abc" * 50 + "x " * 5)) < 200


@pytest.fixture(scope="module")
def rows(spark):
    lines = [f"{SAID[k][i % 2]} {SAID[k][(i + 1) % 2]}" for i in range(60) for k in SAID]
    return spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "row long, text string")


def values(spark, texts):
    return spark.createDataFrame([(i, 1, "assistant", "en", t) for i, t in enumerate(texts)], "row long, pos int, column string, lang string, text string")


def test_cut_texts(spark, rows):
    texts = [
        SAID["en"][0], SAID["en"][0].rstrip("."), SAID["en"][0][:48], SAID["en"][0][:55], SAID["ja"][0][:18], SAID["de"][0][:-1], None, "", "{\"a\"", "The account returned ", SAID["en"][0] + " They compare the night tra",
    ]
    got = {r["row"]: r["cut"] for r in truncated_values(values(spark, texts), rows.select(F.array("text").alias("texts"))).collect()}
    assert got == {0: False, 1: False, 2: True, 3: True, 4: True, 5: False, 7: False, 8: True, 9: True, 10: True}


def test_blanks_and_braces_in_prose_are_no_cuts(spark, rows):
    texts = [SAID["en"][0] + " ", SAID["en"][1] + "\n", SAID["en"][0] + " \u200b", "They asked what a { does. " + SAID["en"][0], "Is that so? ", "The account returned "]
    got = {r["row"]: r["cut"] for r in truncated_values(values(spark, texts), rows.select(F.array("text").alias("texts"))).collect()}
    assert got == {0: False, 1: False, 2: False, 3: False, 4: False, 5: True}


def test_contexts_may_be_split_over_several_filters(spark, rows):
    texts = [SAID["en"][0][:48], SAID["en"][0], SAID["de"][0][:40], SAID["ja"][0][:18], SAID["en"][1][:-1]] * 40
    one = truncated_values(values(spark, texts), rows.select(F.array("text").alias("texts")))
    many = truncated_values(values(spark, texts), rows.select(F.array("text").alias("texts")), filter_bits=1 << 12)
    assert len(list(_filters(spark.range(1000).select(F.xxhash64("id").alias("context")), 1 << 12))) == 4
    key = lambda df: sorted((r["row"], r["cut"], r["reason"], round(r["odds"] or 0, 6)) for r in df.collect())
    assert key(one) == key(many)


def test_limits_are_found(spark, rows):
    texts = [("x" * 150)[: 149 + (i % 40 == 0)] if i >= 40 else "y" * 120 for i in range(60)]
    df = values(spark, texts)
    lengths = spark.createDataFrame([(i, 1, "tokens", 512) for i in range(30)] + [(i, 1, "tokens", 200 + 3 * i) for i in range(30, 60)], "row long, pos int, unit string, length int")
    got = truncated_values(df, rows.select(F.array("text").alias("texts")), lengths).where("limit").count()
    assert got >= 30


def test_nothing_to_do(spark, rows):
    assert truncated_values(values(spark, ["x"]).where("false"), rows.select(F.array("text").alias("texts"))).count() == 0
    assert truncated_values(values(spark, [None]), rows.select(F.array("text").alias("texts")).where("false")).count() == 0


def test_labels(spark):
    labelled = spark.createDataFrame([(k, t) for k in SAID for t in SAID[k]] * 5 + [(None, "x"), ("de", None)], "lang string, text string")
    model = train_languages(labelled, "lang", "text")
    assert model.languages == ["de", "en", "ja"]
    q = "What changed since the last order? The account compares the trains with the ferry."
    pairs = [(1, q, SAID["en"][0], None), (2, q, SAID["de"][0], None), (3, q + " Please answer in German.", SAID["de"][0], None), (4, q, None, None), (5, q, q, None), (6, q, SAID["en"][0], True), (7, None, SAID["de"][0], None), (8, q, "I can't help with this.", True), (9, q, "Kyoto", None)]
    df = spark.createDataFrame([(i, 2, a, b, c) for i, a, b, c in pairs], "regen_id long, msg_pos int, question string, answer string, cut boolean")
    got = {r["regen_id"]: r["defect"] for r in label_pairs(df, model).collect()}
    assert got == {1: None, 2: "wrong_language", 3: None, 4: "empty", 5: "copy", 6: "truncated", 7: None, 8: "refusal", 9: None}
    none = train_languages(labelled.where("false"), "lang", "text")
    assert none.languages == [] and {r["defect"] for r in label_pairs(df.where("regen_id < 3"), none).collect()} == {None}


def test_pairs(spark):
    m = [("system", "s"), ("user", "q"), ("assistant", "a"), ("user", "r"), ("assistant", None), ("assistant", "b")]
    df = spark.createDataFrame([(1, m), (2, []), (3, None), (4, [("assistant", "x")])], "r long, c array<struct<role:string,content:string>>")
    got = [(r["r"], r["msg_pos"], r["question"], r["answer"]) for r in question_answer_pairs(df, "r", "c").collect()]
    assert sorted(got) == [(1, 2, "q", "a"), (1, 4, "r", None)]
