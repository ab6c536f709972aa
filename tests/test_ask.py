import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF
from helpers import queries, garden_store, store
from lexifold import answer_questions, append_audit_log, build_context, build_index, prepare
from lexifold.functions.answers import clean_answer, outranks, parse_reply, source_label
from lexifold.functions.versions import version_key
from lexifold.operators.citations import valid_citations
from lexifold.operators.models import generate_answers
from lexifold.operators.validation import enough_evidence, validate_queries, validate_questions
from lexifold.operators.versioning import resolve_versions
from lexifold.options import RetrievalOptions
from lexifold.plans.ask import NOT_ENOUGH_INFORMATION


def evaluate(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


# --- expressions ---------------------------------------------------------------------------------


def test_source_labels(spark):
    spellings = ["C1", "c1", "[C1]", "1", " ( 1 ) ", "", "x"]
    assert evaluate(spark, *[source_label(F.lit(s)) for s in spellings]) == ["C1"] * 5 + ["", "X"]


def test_answer_markers(spark):
    cases = {
        "[C2] Kapı yedide açılır": "Kapı yedide açılır",
        "Su (C1) sabah, gübre [C4, \"torba\"] akşam verilir": "Su sabah, gübre akşam verilir",
        "Bitti\t [C1] [C2](C3 , C12)": "Bitti",
        "iki  boşluk\t\tkalmaz": "iki boşluk kalmaz",
        "C1 çıplak, [D1] yabancı, (bkz. C1) eksik": "C1 çıplak, [D1] yabancı, (bkz. C1) eksik",
        "": "",
    }
    assert evaluate(spark, *[clean_answer(F.lit(a)) for a in cases]) == list(cases.values())


def test_copies_of_cited_quotes(spark):
    quotes = F.array(F.lit("sabah sulanır"), F.lit(""), F.lit("torba"))
    cases = {
        'Kural: "sabah sulanır" böyledir': "Kural: böyledir",
        "“torba” ve \"torba\" iki kez": "ve iki kez",
        'Başka söz "akşam sulanır" durur': 'Başka söz "akşam sulanır" durur',
        "tırnaksız sabah sulanır durur": "tırnaksız sabah sulanır durur",
        'İçi boş "" durur': 'İçi boş "" durur',
    }
    assert evaluate(spark, *[clean_answer(F.lit(a), quotes) for a in cases]) == list(cases.values())


def test_evidence_gate(spark):
    rows = [("hybrid", 0.81, 0.0), ("hybrid", 0.2, 0.62), ("hybrid", 0.549, 0.499), ("lexical", 0.99, 0.2), ("lexical", 0.0, 0.77)]
    got = evaluate(spark, *[enough_evidence(F.lit(mode), F.lit(dense), F.lit(coverage)) for mode, dense, coverage in rows])
    # Words alone may carry a question in both modes, vectors only where there are any.
    assert got == [coverage >= 0.5 or (mode == "hybrid" and dense >= 0.55) for mode, dense, coverage in rows]


def test_precedence(spark):
    cases = [("politika", 2025, "sss", 2024, True), ("sss", 2024, "politika", 2025, False), ("politika", 2023, "sss", 2025, True),
             ("kilavuz", 2025, "sss", 2025, True), ("prosedur", 2025, "politika", 2024, True), ("prosedur", 2024, "politika", 2025, False),
             ("sss", 2025, "sss", 2025, True)]
    date = lambda y: F.lit(datetime.date(y, 1, 1))
    got = evaluate(spark, *[outranks(F.lit(a), date(x), F.lit(b), date(y)) for a, x, b, y, _ in cases])
    assert got == [e for *_, e in cases]


def test_version_order(spark):
    ordered = ["x", "0.1", "1.9", "1.9.0", "1.9.0.4", "1.10", "2.0"]
    rows = spark.createDataFrame([(v,) for v in reversed(ordered)], "v string")
    assert [r.v for r in rows.orderBy(version_key(F.col("v"))).collect()] == ordered
    bad = ["2", "1.2.3.4.5", "99999999999.1", "1.x", ""]
    assert evaluate(spark, *[version_key(F.lit(v)) for v in bad]) == [[0, 0, -1, -1]] * len(bad)


def test_parse_reply(spark):
    good = '{"answerable": true, "answer": null, "citations": [{"chunkId": "C1"}, {"chunkId": " "}], "extra": 1}'
    parsed = evaluate(spark, *[parse_reply(F.lit(r)) for r in (good, "not JSON", '{"answerable": "no"}', "[]", '{"conflicts": null}')])
    assert [p.valid for p in parsed] == [True, False, False, False, True]
    assert parsed[0].answer == "" and [c.label for c in parsed[0].citations] == ["C1"] and parsed[0].citations[0].quote == ""
    assert not parsed[4].answerable and parsed[4].conflicts == []


def test_query_validation(spark):
    rows = [(0, " iade ", None), (1, " 　", 3), (2, "a" * 501, 3), (3, "iade", 0), (4, "iade", 21), (5, None, 0), (6, "a" * 500, 20)]
    checked = validate_queries(spark.createDataFrame(rows, "query_id int, text string, top_k int")).orderBy("query_id").collect()
    assert [r.message_code for r in checked] == [
        None, "query_required", "query_too_long", "top_k_out_of_range", "top_k_out_of_range", "query_required", None,
    ]
    assert [r.status for r in checked] == [200, 400, 400, 400, 400, 400, 200] and checked[0].text == "iade" and checked[0].top_k == 6
    asked = validate_questions(spark.createDataFrame([(0, "iade"), (1, "")], "query_id int, text string"), index_ready=False)
    assert [(r.status, r.message_code) for r in asked.orderBy("query_id").collect()] == [(503, "index_not_ready"), (400, "question_required")]


# --- version resolution --------------------------------------------------------------------------

# Ferry timetables: one begins on the day asked about, one a day later; tariffs and a pier with a single version each.
WINTER = ("sefer-kis", "sefer", "2.3", datetime.date(2024, 11, 4), "active")
SPRING = ("sefer-bahar", "sefer", "2.10", datetime.date(2026, 3, 9), "active")
TODAY = ("sefer-guz", "sefer", "3.0", datetime.date(2026, 10, 1), "active")
TOMORROW = ("sefer-ek", "sefer", "3.1", datetime.date(2026, 10, 2), "active")
TARIFF = ("bilet", "bilet", "7.0", datetime.date(2026, 1, 5), "superseded")
PIER = ("iskele", "iskele", "1.0", datetime.date(2020, 5, 17), "active")
SCHEMA = "source_id string, document_key string, version string, effective_date date, status string, title string, file_name string"


def resolve(spark, hits, catalogue):
    full = lambda v: (*v, f"Belge {v[1]}", f"{v[0]}.md")
    versions = spark.createDataFrame([full(v) for v in catalogue], SCHEMA)
    ranked = spark.createDataFrame([(0, i + 1, *full(v)) for i, v in enumerate(hits)], f"query_id int, rank int, {SCHEMA}")
    found = resolve_versions(ranked, versions, AS_OF)
    ids = lambda df, order: [r.source_id for r in df.orderBy(order).collect()]
    return {
        "kept": ids(found.kept, "rank"),
        "selected": ids(found.selected, "first_rank"),
        "discarded": {r.source_id: r.reason for r in found.discarded.collect()},
        "needs": {r.source_id: r.replaced_rank for r in found.needs_substitution.collect()},
    }


def test_a_version_counts_from_its_very_day(spark):
    got = resolve(spark, [TOMORROW, SPRING, TODAY, PIER], [WINTER, SPRING, TODAY, TOMORROW, PIER])
    assert got["kept"] == ["sefer-guz", "iskele"] and got["selected"] == ["sefer-guz"] and got["needs"] == {}
    assert got["discarded"] == {
        "sefer-ek": "Yürürlük tarihi (2026-10-02) henüz gelmedi.",
        "sefer-bahar": "3.0 sürümü (2026-10-01) tarafından geçersiz kılındı.",
    }


def test_only_old_timetables_were_found(spark):
    got = resolve(spark, [PIER, TARIFF, SPRING, WINTER, SPRING], [WINTER, SPRING, TODAY, TARIFF, PIER])
    # A document of a single version stays, whatever its status; the family's best rank goes to today's timetable.
    assert got["kept"] == ["iskele", "bilet"] and got["needs"] == {"sefer-guz": 3}
    assert set(got["discarded"]) == {"sefer-bahar", "sefer-kis"}


def test_nothing_of_the_family_is_in_effect(spark):
    closed = (*WINTER[:4], "superseded")
    got = resolve(spark, [closed, TOMORROW], [closed, TOMORROW])
    assert got["kept"] == got["selected"] == [] and got["needs"] == {}
    assert got["discarded"]["sefer-kis"] == "Bu dokümanın yürürlükte bir sürümü yok."


def test_current_version_of_random_families(spark):
    rng = random.Random(11)
    days = [datetime.date(2026, 9, 29) + datetime.timedelta(days=d) for d in range(5)]
    numbers = ["0.9", "1.9", "1.10", "1.10.1"]
    catalogue = [
        (f"r{i:02}", f"aile-{i % 14}", rng.choice(numbers), rng.choice(days), rng.choice(["active", "active", "superseded"])) for i in range(70)
    ]
    hits = rng.sample(catalogue, 40)
    got = resolve(spark, hits, catalogue)
    current = {}
    for version in catalogue:
        _, family, number, day, state = version
        if state == "active" and day <= AS_OF:
            # Latest day, then highest number, then the first file name.
            rank = (day, [int(n) for n in number.split(".")])
            if family not in current or rank > current[family][0]:
                current[family] = (rank, version[0])
    chosen = {family: name for family, (_, name) in current.items()}
    assert got["kept"] == [v[0] for v in hits if chosen.get(v[1]) == v[0]]
    assert set(got["discarded"]) == {v[0] for v in hits if chosen.get(v[1]) != v[0]}
    best = {}
    for place, v in enumerate(hits):
        best.setdefault(v[1], place + 1)
    met = {v[0] for v in hits}
    assert got["needs"] == {chosen[family]: place for family, place in best.items() if family in chosen and chosen[family] not in met}


# --- citations -----------------------------------------------------------------------------------


def test_citations(spark):
    context = spark.createDataFrame(
        [(0, "C1", "Bisikletler, güverteye kalkıştan en geç 12 dakika önce görevli eşliğinde alınır."), (0, "C2", "Evcil hayvan ücretsizdir.")],
        "query_id int, label string, content string",
    )
    for name in ("document_key", "source_id", "title", "version", "status", "category", "section_path"):
        context = context.withColumn(name, F.lit("x"))
    context = context.withColumn("effective_date", F.current_date())
    told = [("C9", "uydurma"), ("C2", "hayvan bedava"), ("c1", "12 DAKIKA ONCE GOREVLI"), ("[C1]", " geç 12 dakika … alınır "),
            ("1", "12 DAKIKA ONCE GOREVLI"), ("C1", "..."), ("C1", "dakika ... saat")]
    replies = spark.createDataFrame([(0, told)], "query_id int, citations array<struct<label:string,quote:string>>")
    got = [(r.position, r.label, r.quote_verified) for r in valid_citations(replies, context).orderBy("position").collect()]
    assert got == [(1, "C2", False), (2, "C1", True), (3, "C1", True), (5, "C1", False), (6, "C1", False)]


# --- whole pipeline ------------------------------------------------------------------------------


def reply(answerable=True, answer="", citations=(), missing="", conflicts=()):
    return {
        "text": json.dumps({
            "answerable": answerable, "answer": answer, "citations": [{"chunkId": c, "quote": q} for c, q in citations],
            "missingInformation": missing,
            "conflicts": [{"topic": "konu", "chosenChunkId": c, "rejectedChunkIds": r, "reason": "neden"} for c, r in conflicts],
        }),
        "model": "test-model", "input_tokens": 10, "output_tokens": 5,
    }


def sources_of(messages):
    """[(label, title line, content)] of the prompt."""
    blocks = messages[1]["content"].split("KAYNAKLAR:\n\n", 1)[1].split("SORU: ")[0].split("\n\n")
    return [(b[1:].split("]")[0], b.split("\n")[0], b.split("\n")[1], "\n".join(b.split("\n")[2:])) for b in blocks if b]


def quote_first(messages):
    label, _, _, content = sources_of(messages)[0]
    return reply(answer=content, citations=[(label, content)])


@pytest.fixture(scope="module")
def index(spark):
    return build_index(garden_store(spark))


def ask(spark, index, question, generate=quote_first, **options):
    return answer_questions(index, queries(spark, question), generate, AS_OF, **options).first()


WATERING = "Parseller sulanır mı?"


def test_answer_names_version_section_and_discarded_versions(spark, index, tmp_path):
    far = "Uçak kaçta kalkar?"
    answers = answer_questions(index, queries(spark, WATERING, far, "  ", "a" * 501), quote_first, AS_OF)
    rows = {r.query_id: r for r in answers.collect()}
    assert [rows[i].status for i in range(4)] == [200, 200, 400, 400]
    assert [rows[i].message_code for i in range(4)] == [None, None, "question_required", "question_too_long"]
    answered = rows[0]
    assert answered.answerable and answered.refusal_reason == ""
    assert answered.answer == "Parseller sabah yediden önce damlama hattıyla sulanır."
    (source,) = answered.sources
    assert (source.documentId, source.version, source.effectiveDate, source.section, source.quoteVerified) == (
        "parsel-2025", "1.5", "2025-03-01", "Sulama", True)
    assert answered.version_resolution.applied
    assert [v.documentId for v in answered.version_resolution.selected] == ["parsel-2025"]
    assert {v.documentId for v in answered.version_resolution.discarded} == {"parsel-2023", "parsel-2027"}
    refused = rows[1]
    assert (refused.answerable, refused.refusal_reason, refused.answer, refused.sources) == (False, "LowRelevance", NOT_ENOUGH_INFORMATION, [])
    assert not refused.version_resolution.applied and refused.model == "" and refused.latency_ms > 0
    body = json.loads(answered.response_json)
    assert body["diagnostics"]["retrievalMode"] == "lexical" and body["diagnostics"]["inputTokens"] == 10
    assert body["diagnostics"]["candidateDocumentIds"][0].startswith("parsel-") and body["missingInformation"] == ""
    assert body["diagnostics"]["latencyMs"] == answered.latency_ms >= refused.latency_ms
    assert "sürüm" in answered.response_json and json.loads(refused.response_json)["diagnostics"]["inputTokens"] is None

    append_audit_log(answers, str(tmp_path / "log"))
    logged = spark.read.parquet(str(tmp_path / "log")).collect()
    assert {r.question for r in logged} == {WATERING, far}


def test_context_leaves_out_discarded_versions(spark, index):
    asked = build_context(index, prepare(index, queries(spark, WATERING)), AS_OF)
    context = asked.context.orderBy("position").collect()
    assert [c.label for c in context] == [f"C{i + 1}" for i in range(len(context))]
    assert {c.source_id for c in context} == {"parsel-2025"}
    prompt = asked.prompts.first()["prompt"]
    first = context[0]
    assert prompt.startswith(f"KAYNAKLAR:\n\n[C1] {first.title} | sürüm {first.version} | yürürlük {first.effective_date} | tür: {first.category}\nBölüm: {first.section_path}\n{first.content}\n\n")
    assert prompt.endswith(f"SORU: {WATERING}")


def test_no_index_and_repeated_questions(spark, index):
    asked = queries(spark, WATERING, " ", "a" * 501)
    got = [(r.status, r.message_code, r.answerable) for r in answer_questions(None, asked, quote_first, AS_OF).orderBy("query_id").collect()]
    assert got == [(503, "index_not_ready", False), (400, "question_required", False), (400, "question_too_long", False)]
    with pytest.raises(ValueError, match="unique"):
        answer_questions(index, asked.union(asked), quote_first, AS_OF)


def test_prompts_are_spread_over_tasks(spark):
    from pyspark import TaskContext

    def where(messages):
        return {**reply(False), "model": str(TaskContext.get().partitionId())}

    prompts = spark.range(40).selectExpr("id as query_id", "'x' as prompt").coalesce(1)
    assert len({r.model for r in generate_answers(prompts, where, parallel_calls=6).collect()}) > 3


def test_substitutes_take_the_place_of_the_outdated_hit(spark):
    index = build_index(store(
        spark,
        ("g-v1", "g", "1.0", "2024-01-01", "active", "politika", "Garanti", [("Süre", "eski cihaz garantisi iki yıl")]),
        ("g-v2", "g", "2.0", "2025-01-01", "active", "politika", "Yeni", [
            ("A", "garantisi üç yıl"), ("B", "yıl üç"), ("C", "garantisi iki yıl sürer")]),
        ("h", "h", "1.0", "2025-01-01", "active", "sss", "Hediye", [("D", "eski cihaz garantisi hediye")]),
    ))
    prepared = prepare(index, queries(spark, "eski cihaz garantisi iki yıl"))
    asked = build_context(index, prepared, AS_OF, RetrievalOptions(top_k=3, candidate_pool=2))
    assert [h.source_id for h in asked.hits.orderBy("rank").collect()] == ["g-v1", "h"]
    placed = [(c.label, c.source_id, c.chunk_order) for c in asked.context.orderBy("position").collect()]
    assert placed == [("C1", "g-v2", 2), ("C2", "g-v2", 0), ("C3", "h", 0)]
    cut = build_context(index, prepared, AS_OF, RetrievalOptions(top_k=1, candidate_pool=2))
    assert [(c.source_id, c.chunk_order) for c in cut.context.collect()] == [("g-v2", 2)]


def test_report_scope(spark, index):
    question = "Kompost torbaları, anahtar"

    def cite_compost(messages):
        label, _, _, content = next(s for s in sources_of(messages) if "Kompost rehberi" in s[1])
        return reply(answer=content, citations=[(label, content)])

    cited = ask(spark, index, question, cite_compost)
    assert [s.documentId for s in cited.sources] == ["kompost"]
    assert (cited.version_resolution.applied, cited.version_resolution.selected, cited.version_resolution.discarded) == (False, [], [])
    retrieved = ask(spark, index, question, cite_compost, report_scope="retrieved")
    assert retrieved.version_resolution.applied and [d.documentId for d in retrieved.version_resolution.discarded] == ["parsel-2023"]


def test_what_a_generator_may_do(spark, index):
    """One batch; single letters are no search terms, so the last one only tells the generator what to do."""
    calls = {
        "a": lambda m: reply(False, missing=" Kaynak yetersiz. "),
        "b": lambda m: reply(answer="Sabah.", citations=[("C9", "sabah")]),
        "d": lambda m: {"text": "JSON değil"},
        "e": lambda m: {"text": "?"} if len(m) == 2 else quote_first(m),
    }

    def generate(messages):
        letter = messages[1]["content"][-1]
        if letter == "c":
            raise ConnectionError("down")
        if letter in "fg":
            labels = {s[1].split("] ")[1].split(" |")[0]: s[0] for s in sources_of(messages) if "Anahtar" in s[2]}
            rules, faq = labels["Parsel kuralları"], labels["Sorular"]
            chosen, other = (rules, faq) if letter == "f" else (faq, rules)
            return reply(answer="Yüz lira.", citations=[(chosen, "anahtar")], conflicts=[
                (chosen, [other, other.lower(), chosen, "C9"]), ("C9", [other]), (chosen, [chosen]),
            ])
        return calls[letter](messages)

    texts = [f"{WATERING} {letter}" for letter in "abcde"] + [f"Anahtar depozitosu? {letter}" for letter in "fg"]
    a, b, c, d, e, f, g = answer_questions(index, queries(spark, *texts), generate, AS_OF).orderBy("query_id").collect()
    assert (a.answerable, a.refusal_reason, a.missing_information, a.answer) == (
        False, "ModelInsufficientContext", "Kaynak yetersiz.", NOT_ENOUGH_INFORMATION)
    assert (b.answerable, b.refusal_reason, b.sources) == (False, "NoValidCitations", [])
    for refused in (a, b):  # a refusal says which versions were passed over
        assert refused.version_resolution.applied and {v.documentId for v in refused.version_resolution.discarded} == {"parsel-2023", "parsel-2027"}
    assert (c.status, c.message_code, c.response_json) == (503, "generator_unavailable", None)
    assert (d.status, d.message_code, d.answerable) == (502, "reply_invalid", False)
    assert e.answerable and e.status == 200
    for row, satisfied in ((f, True), (g, False)):
        (conflict,) = row.conflicts
        assert len(conflict.rejected) == 1 and conflict.ruleSatisfied is satisfied and conflict.topic == "konu"
