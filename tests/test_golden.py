"""Hand-computed rows at the edges of each formula."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mailquarry.functions import files as fl
from mailquarry.functions import links as lk
from mailquarry.functions import net
from mailquarry.operators import attachments, behaviour, content, ensemble, headers, reputation, urls
from mailquarry.sinks import maintenance


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def one(spark, value, column):
    return values(spark, [(value,)], "x string", column)[0]


@pytest.mark.parametrize("length,score", [(100, 0.0), (101, 0.3), (200, 0.3), (201, 0.6), (300, 0.6), (301, 0.9)])
def test_url_length(spark, length, score):
    assert one(spark, "h" * length, lk.length_score(F.col("x"))) == score


@pytest.mark.parametrize("url,score", [
    ("http://10.1.2.3/x", 0.8),                     # bare address
    ("http://a.b.c.example.net/", 0.3),             # five labels
    ("http://b.c.example.net/", 0.0),               # four labels
    ("http://paypal.com/", 0.0),                    # exact brand
    ("http://paypa1.com/", 0.8),                    # one letter changed
    ("http://gooogle.tk/", 1.0),                    # typosquat and suspicious ending, clamped
    ("http://is.gd/a", 0.4),
])
def test_domain_score(spark, url, score):
    assert one(spark, url, lk.domain_score(F.col("x"), lk.authority(F.col("x")), lk.brand_similarity(lk.authority(F.col("x"))))) == pytest.approx(score)


@pytest.mark.parametrize("path,score", [
    ("/%41%42%43", 0.0), ("/%41%42%43%44", 0.4), ("/login/verify", 0.4), ("/login/verify/update/secure/account/x", 1.0)])
def test_path_score(spark, path, score):
    assert one(spark, path, lk.path_score(F.col("x"))) == pytest.approx(score)


@pytest.mark.parametrize("query,score", [
    ("", 0.0), ("next=1&next=2", 0.3), ("url=&link=1", 0.3), ("redirect=a&goto=b&t=" + "a" * 21, 1.0),
    ("t=" + "a" * 20, 0.0), ("t=" + "a" * 21, 0.4), ("t=" + "a" * 21 + "+b", 0.0)])
def test_query_score(spark, query, score):
    assert one(spark, query, lk.query_score(F.col("x"))) == pytest.approx(score)


def test_url_parts(spark):
    url = "HTTPS://User@Ex.com:80/A/b;v=1?Q=1#f"
    assert one(spark, url, lk.authority(F.col("x"))) == "user@ex.com:80"
    assert one(spark, url, lk.path(F.col("x"))) == "/a/b"
    assert one(spark, url, lk.query(F.col("x"))) == "q=1"
    assert one(spark, "http://[::1/x", lk.unparsable(lk.authority(F.col("x")))) is True
    assert one(spark, "http://[::1]/x", lk.unparsable(lk.authority(F.col("x")))) is False


def test_unparsable_url_scores_half(spark):
    links = spark.createDataFrame([("m", "http://[::1/login"), ("m", "http://example.org/")], "message_id string, url string")
    none = spark.createDataFrame([], "url string, vendor string, reputation_score double, is_malicious boolean, threat_types array<string>")
    rows = {r.url: r for r in urls.score_links(links, none).collect()}
    assert rows["http://[::1/login"].threat_score == 0.5 and rows["http://[::1/login"].is_malicious is False
    assert rows["http://example.org/"].reputation_category == "CLEAN"


def test_link_extraction_keeps_order_and_trims(spark):
    mails = spark.createDataFrame([("m", "see http://b.example/x., http://a.example! http://b.example/x")], "message_id string, content string")
    assert [(r.pos, r.url) for r in urls.extract_links(mails).orderBy("pos").collect()] == [
        (0, "http://b.example/x"), (1, "http://a.example")]


@pytest.mark.parametrize("name,ext,score", [
    ("a.pdf.exe", ".exe", 0.9), ("a.exe", ".exe", 0.9), ("a.pdf.app", ".app", 0.9), ("a.app", ".app", 0.8),
    ("a.tar.gz", ".tar.gz", 0.3), ("a", "", 0.0), (".bashrc", "", 0.0), ("a.", "", 0.0), ("A.JS", ".js", 0.6)])
def test_extension(spark, name, ext, score):
    assert one(spark, name, fl.extension(F.col("x"))) == ext
    assert one(spark, name, fl.extension_score(F.col("x"), fl.extension(F.col("x")))) == score


def test_sizes_and_names(spark):
    sizes = [(0,), (1,), (1023,), (1024,), (100 * 1024 * 1024,), (100 * 1024 * 1024 + 1,)]
    assert values(spark, sizes, "x bigint", fl.size_score(F.col("x"))) == [0.3, 0.2, 0.2, 0.0, 0.0, 0.4]
    # 20 and 21 characters, more than half digits
    assert one(spark, "12345678901234567.txt"[:20], fl.name_score(F.col("x"), F.lit(".txt"))) == 0.0
    assert one(spark, "12345678901234567.txt", fl.name_score(F.col("x"), F.lit(".txt"))) == 0.2
    assert one(spark, "invoice receipt.exe", fl.name_score(F.col("x"), F.lit(".exe"))) == pytest.approx(0.6)
    assert one(spark, "invoice.txt", fl.name_score(F.col("x"), F.lit(".txt"))) == 0.0


def test_file_without_name_or_data(spark):
    files = spark.createDataFrame([("m", None, 5, "text/plain", None), ("m", "a.txt", 2000, "text/plain", "*not base64*")],
                                  "message_id string, filename string, file_size bigint, mime_type string, file_data string")
    none = spark.createDataFrame([], "file_hash string, vendor string, reputation_score double, is_malicious boolean, threat_types array<string>")
    rows = {r.filename: r for r in attachments.score_files(files, none).collect()}
    assert rows[None].threat_score == 0.5 and not rows[None].is_malware
    assert rows["a.txt"].threat_score == 0.0 and rows["a.txt"].file_hash is None


def test_malware_family_prefers_first_match(spark):
    files = spark.createDataFrame([("m", "a.exe", 0, "application/x-msdownload", "dXJnZW50IGNsaWNrIGhlcmU=")],
                                  "message_id string, filename string, file_size bigint, mime_type string, file_data string")
    hashed = attachments.file_hashes(files).select("file_hash").first()[0]
    verdicts = spark.createDataFrame([(hashed, "scan", 0.0, True, ["generic", "crypto.x", "trojan"])],
                                     "file_hash string, vendor string, reputation_score double, is_malicious boolean, threat_types array<string>")
    row = attachments.score_files(files, verdicts).first()
    assert row.rule_score == 0.8 and row.malware_family == "Ransomware"
    assert row.threat_score == pytest.approx((0.9 * 0.4 + 0.3 * 0.1 + 0.8 * 0.3) * 0.2 + 0.8 * 0.3 + 0.5)


@pytest.mark.parametrize("ip,public", [
    ("8.8.8.8", True), ("10.0.0.1", False), ("172.15.255.255", True), ("172.16.0.0", False), ("172.32.0.0", True),
    ("256.1.1.1", False), ("240.0.0.1", False), ("198.19.255.255", False), ("192.0.1.0", True)])
def test_public_addresses(spark, ip, public):
    assert one(spark, ip, net.is_public(net.ip_number(F.col("x")))) is public


def test_address_borders(spark):
    text = "from x ([8.8.8.8]) 1.2.3.4.5 v1.2.3.4 1234.1.1.1 9.9.9.9"
    assert one(spark, text, net.public_ips(F.col("x"))) == ["8.8.8.8", "1.2.3.4", "9.9.9.9"]


@pytest.mark.parametrize("text,want", [
    ("Fri, 05 Jan 2024 01:00:00 +0200", (1704409200, 120)), ("5 Jan 2024 01:00 EST", (1704434400, -300)),
    ("Mon, 01 Jan 2024 00:00:00 +0000 (UTC)", (1704067200, 0)), ("yesterday", None), ("99 Jan 2024 01:00:00 +0000", None)])
def test_mail_dates(spark, text, want):
    got = one(spark, text, net.mail_times(F.array("x")))
    assert [(g.epoch, g.zone_minutes) for g in got] == ([] if want is None else [want])


def head(spark, entries):
    return spark.createDataFrame([("m", entries)], "message_id string, headers array<struct<name:string,value:string>>")


def ranges(spark):
    rows = [("CN", 20 << 24, (21 << 24) - 1), ("US", 134744072, 134744072)]
    return spark.createDataFrame(rows, "country string, start_ip bigint, end_ip bigint")


NOW = "2024-02-01 00:00:00"


def score(spark, entries):
    return headers.score_headers(head(spark, entries), ranges(spark), F.lit(NOW).cast("timestamp")).first()


def test_no_headers(spark):
    row = score(spark, [])
    assert (row.header_score, row.authentication_score, row.routing_score) == (0.5, 0.5, 0.5)
    assert row.warnings == ["No headers available for analysis"]


def test_softfail_is_not_fail(spark):
    row = headers.authentication(head(spark, [("Received-SPF", "SoftFail"), ("DKIM-Signature", "v=1")])).first()
    assert (row.spf_score, row.dkim_score, row.dmarc_score) == (0.7, 0.2, 0.5)


def hop(ip, when):
    return ("Received", f"from h.example ([{ip}]) by mx.example; {when}")


def test_reversed_hop_and_gaps(spark):
    def times(*stamps):
        row = headers.timestamps(head(spark, [hop("8.8.8.8", s) for s in stamps]), F.lit(NOW).cast("timestamp")).first()
        return row.timestamp_score, row.timestamp_anomalies, row.timezone_inconsistencies

    late, early = "Tue, 02 Jan 2024 00:00:00 +0000", "Mon, 01 Jan 2024 00:00:00 +0000"
    assert times(late, early) == (0.0, False, False)                       # exactly 86,400 s
    assert times("Tue, 02 Jan 2024 00:00:01 +0000", early) == (0.3, False, False)
    assert times(early, late) == (0.6, True, False)
    assert times("Mon, 01 Jan 2024 02:00:00 +0200", early) == (0.2, False, True)
    assert times("Fri, 02 Feb 2024 02:00:00 +0000", "Fri, 02 Feb 2024 01:59:00 +0000") == (0.4, False, False)
    assert times(early) == (0.0, False, False)


def test_hop_counts_and_countries(spark):
    def route(n, ip):
        return headers.routing(head(spark, [hop(ip, "x")] * n), ranges(spark)).first().routing_score

    assert route(0, "8.8.8.8") == 0.4 and route(1, "8.8.8.8") == 0.4
    assert route(2, "8.8.8.8") == 0.0 and route(10, "8.8.8.8") == 0.0 and route(11, "8.8.8.8") == 0.3
    assert route(2, "20.1.2.3") == pytest.approx(0.6) and route(4, "20.1.2.3") == 1.0
    assert route(2, "10.0.0.1") == 0.0


def test_sender_mismatch(spark):
    row = headers.sender(head(spark, [("From", "A <a@tempmail.example>"), ("Return-Path", "<B@x.example>")]), ranges(spark)).first()
    assert row.return_path_mismatch and row.sender_score == pytest.approx(0.8)


def mail(spark, content_, kind="text", subject="", lang="en"):
    return spark.createDataFrame([("m", "s@x", subject, kind, content_, lang)],
                                 "message_id string, sender string, subject string, content_type string, content string, lang string")


def test_content_edges(spark):
    empty = content.content_features(mail(spark, "")).first()
    assert (empty.text_length, empty.word_count, empty.sentence_count, empty.avg_word_length) == (2, 0, 1, 0.0)
    row = content.content_features(mail(spark, "Hellooo qxz bankers ABC. ök x! aaab_c", subject="Bank")).first()
    assert row.word_count == 8
    assert row.financial_words_count == 1          # inside a longer word, counted once
    assert row.spelling_errors == 2                # hellooo and qxz; aaab_c is no plain word
    assert row.all_caps_ratio == pytest.approx(1 / 8)
    html = content.content_features(mail(spark, "<p>you're  welcome</p><i style='display:none'>", "html")).first()
    assert (html.html_tag_count, html.hidden_text, html.grammar_errors) == (3, 1, 1)


def test_wide_spaces_part_words(spark):
    row = content.content_features(mail(spark, "a\u00a0b\u3000c\u2003d e\u0085f")).first()
    assert (row.word_count, row.avg_word_length) == (6, 1.0)
    # inside the quickly tested range but no space
    assert content.content_features(mail(spark, "a\u2026b c")).first().word_count == 2


def test_manipulation_language_fallback(spark):
    assert content.manipulation(mail(spark, "urgent bank", lang="de")).first().detected_language == "de"
    assert content.manipulation(mail(spark, "urgent bank", lang="xx")).first().detected_language == "en"
    row = content.manipulation(mail(spark, "URGENTE: banco", lang="es")).first()
    assert row.urgency == 0.2 and row.authority_terms == ["banco"]


def test_readability(spark):
    row = content.style(mail(spark, "The cat came home. It slept.")).first()
    # 6 words, 3 sentences; syllables the 1, cat 1, came 1, home. 2 (ends in a dot), it 1, slept. 1
    assert row.readability == pytest.approx(min(100.0, 206.835 - 1.015 * 2 - 84.6 * 7 / 6))
    assert content.style(mail(spark, "  ")).first().readability == 0.0


def test_base64_rule_needs_more_than_three(spark):
    blob = "A" * 24
    hit = lambda n: [m.rule_name for m in content.scan_text(mail(spark, " ".join([blob] * n))).first().matches]
    assert hit(3) == [] and hit(4) == ["Base64_Encoded_Content"]


def predictions(spark, rows):
    return spark.createDataFrame(rows, "message_id string, model_name string, probability double, error string")


@pytest.mark.parametrize("rows,probability,prediction", [
    ([("m", "svm", 0.9, "x")], 0.5, False),
    ([("m", "svm", 0.8, None), ("m", "deep_learning", 0.4, None)], 0.6, False),
    ([("m", "random_forest", 1.0, None), ("m", "svm", 1.0, None), ("m", "deep_learning", 0.0, None)], 0.6, False),
    ([("m", "ensemble", 0.6, None), ("m", "svm", 0.0, None)], 0.6, True),
])
def test_soft_average(spark, rows, probability, prediction):
    row = ensemble.soft_average(predictions(spark, rows)).first()
    assert row.probability == pytest.approx(probability) and row.prediction is prediction


def test_failed_ensemble_is_undecided(spark):
    row = ensemble.soft_average(predictions(spark, [("m", "ensemble", 0.9, "x"), ("m", "svm", 0.9, None)])).first()
    assert row.model_mean == 0.5 and row.probability == pytest.approx(0.9)


@pytest.mark.parametrize("score_,level", [(0.49, "LOW"), (0.5, "MEDIUM"), (0.7, "HIGH"), (0.9, "CRITICAL"), (1.0, "CRITICAL")])
def test_levels(spark, score_, level):
    assert values(spark, [(score_,)], "x double", ensemble.level(F.col("x"))) == [level]


def test_verdict_limits(spark):
    columns = "message_id string, content_score double, url_score double, attachment_score double, header_score double, model_mean double"
    rows = ensemble.verdict(spark.createDataFrame([("a", 0.0, 0.0, 0.0, 0.0, 0.0), ("b", 1.0, 1.0, 1.0, 1.0, 1.0)], columns)).collect()
    assert [(r.threat_score, r.is_phishing) for r in rows] == [(0.0, False), (pytest.approx(1.0), True)]


def test_ioc_verdict_edges(spark):
    def verdict(*scores):
        rows = [("i", "url", f"s{n}", s, None if s is not None else "down", False, None) for n, s in enumerate(scores)]
        return reputation.aggregate_verdicts(spark.createDataFrame(
            rows, "ioc string, ioc_type string, source string, threat_score double, error string, detected boolean, threat_type string")).first()

    assert verdict(None, None).verdict == "UNKNOWN" and verdict(None).sources_responded == 0
    assert [verdict(s).verdict for s in (0.1, 0.4, 0.7, 0.71)] == ["CLEAN", "QUESTIONABLE", "SUSPICIOUS", "MALICIOUS"]


def history(spark, rows):
    return spark.createDataFrame(
        [(f"o{i}", s, r, dt.datetime(2024, 1, 1) + dt.timedelta(days=d), n, "s") for i, (s, r, d, n) in enumerate(rows)],
        "message_id string, sender string, recipients array<string>, sent_at timestamp_ntz, body_length bigint, subject string")


def test_behaviour_needs_ten_mails(spark):
    nine = history(spark, [("a", ["x"], d, 100) for d in range(9)])
    ten = history(spark, [("a", ["x"], d, 100) for d in range(10)])
    at = "2024-06-01 00:00:00"
    assert behaviour.anomaly(nine, at).first().behavioral_anomaly_score == 0.0
    # no recent mail: all usual recipients are missing
    assert behaviour.anomaly(ten, at).first().behavioral_anomaly_score == pytest.approx(0.4)
    assert behaviour.anomaly(ten, "2024-01-10 00:00:00").first().behavioral_anomaly_score == 0.0


def test_recipient_ties_go_by_first_appearance(spark):
    rows = history(spark, [("a", [r], d, 1) for d, r in enumerate(["c", "b", "a", "f", "e", "d", "b"])])
    assert [r.recipient for r in behaviour.top_recipients(rows).orderBy("rank").collect()] == ["b", "c", "a", "f", "e"]


def test_upsert(spark):
    now = dt.datetime(2024, 1, 2)
    current = spark.createDataFrame(
        [("a", "s", "r", "sub", "HIGH", 0.8, True, 0.6, "old", True, dt.datetime(2024, 1, 1), None)],
        "email_id string, sender_email string, recipient_email string, subject string, threat_level string, threat_score double, "
        "is_phishing boolean, confidence double, analysis_details string, is_quarantined boolean, created_at timestamp_ntz, updated_at timestamp_ntz")

    def result(key, seq, level):
        return (key, seq, f"s{seq}", "r2", "sub2", level, 0.1, False, 0.8, f"new{seq}", now + dt.timedelta(minutes=seq))

    incoming = spark.createDataFrame(
        [result("a", 1, "CRITICAL"), result("a", 2, "LOW"), result("b", 1, "CRITICAL"), result("b", 2, "HIGH"), result("c", 3, "LOW")],
        "email_id string, seq int, sender_email string, recipient_email string, subject string, threat_level string, threat_score double, "
        "is_phishing boolean, confidence double, analysis_details string, received_at timestamp_ntz")
    rows = {r.email_id: r for r in maintenance.upsert(current, incoming).collect()}
    assert rows["a"].sender_email == "s" and rows["a"].threat_level == "LOW" and rows["a"].is_quarantined is False
    assert rows["a"].created_at == dt.datetime(2024, 1, 1) and rows["a"].updated_at == now + dt.timedelta(minutes=2)
    assert rows["b"].sender_email == "s1" and rows["b"].is_quarantined is True and rows["b"].analysis_details == "new2"
    again = {r.email_id: r for r in maintenance.upsert(maintenance.upsert(current, incoming), incoming).collect()}
    assert again == rows and rows["c"].updated_at is None
    changed = incoming.where("email_id = 'c'").withColumn("threat_level", F.lit("HIGH"))
    assert maintenance.upsert(maintenance.upsert(current, incoming), changed).where("email_id = 'c'").first().updated_at == now + dt.timedelta(minutes=3)
