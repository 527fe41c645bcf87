"""Extraction, payloads, metadata and sinks."""

import json
import random
import re
from unittest import mock

import pytest
from pyspark.sql import functions as F

from leadloom import schemas, vocab
from leadloom.functions.profile import profile_text
from leadloom.sources import pages as G
from leadloom.sources import sinks as K
from leadloom.sources import tables as T
from leadloom.sources.payloads import contacts_from_payload


def pages(spark, *html):
    return spark.createDataFrame([(i, h) for i, h in enumerate(html)], "page_id int, html string")


def test_table_rows_skip_header_and_short_rows(spark):
    html = ('<table class="tbl"><tr><td><a href="/h">Head</a></td><td>1</td><td>2</td></tr>'
            '<tr><td> <a href="/a">A &amp; <b>B</b></a></td><td>1,234 LCAs</td><td>x</td></tr>'
            '<tr><td><a href="/s">Short</a></td><td>1</td></tr>'
            '<tr><td>No link</td><td>1</td><td>2</td></tr>'
            '<tr><td><a href="https://o.example/c">C</a></td><td>none</td><td></td></tr></table>')
    out = G.extract_table_rows(pages(spark, html, "<p>no table</p>"), "https://base.example")
    assert [tuple(r) for r in out.select("name", "lca_count", "company_url").collect()] == [
        ("A &B", 1234, "https://base.example/a"), ("C", 0, "https://o.example/c")]


CARD = ('<div class="base-card x"><div class="in"><h3 class="t"> Role <b>One</b></h3></div>'
        '<span class="loc big">Town</span><a class="go" href="/j/1?x=2">see &amp; go</a></div>')
FIELDS = (G.TagField("role", "h3", "t", required=True), G.TagField("location", "span", "loc"),
          G.TagField("jd_url", "a", "go", attr="href"))


def test_nested_cards(spark):
    html = CARD + '<div class="base-card"><span class="loc">X</span></div><div class="other"></div>'
    out = G.extract_nested_cards(pages(spark, html, None, "<div"), "div", "base-card", FIELDS)
    assert [tuple(r) for r in out.collect()] == [(0, 0, "RoleOne", "Town", "/j/1?x=2")]


def test_text_of_nested_blocks(spark):
    html = ('<div class="x"><div id="d" class="a show-more-less-html__markup"><div>One &eacute;</div><p>two'
            '<div>three</div></p></div>after</div>')
    out = G.extract_text(pages(spark, html)).collect()
    assert [r["text"] for r in out] == ["One é\ntwo\nthree"]


def test_text_block(spark):
    html = "<article> <h1>A</h1><p>b <i>c</i></p>\n<br></article><article>no</article>"
    out = G.extract_text(pages(spark, html, "<p>none</p>"), "article").orderBy("page_id").collect()
    assert [r["text"] for r in out] == ["A\nb\nc", ""]


def test_a_reference_cut_off_before_its_end_stays(spark):
    cut = "<article>a &amp; b &amp</article>"
    out = G.extract_text(pages(spark, cut, cut + "<script>x &amp; y</script>"), "article").collect()
    assert [r["text"] for r in out] == ["a & b &amp", "a & b &amp"]
    card = '<div class="c"><a href="/x?a=1&amp;b&lt" class="go">x &am&copy;&notit;</a></div>'
    fields = (G.TagField("text", "a"), G.TagField("jd_url", "a", attr="href"))
    out = G.extract_nested_cards(pages(spark, card, card + "<br/>"), "div", "c", fields).collect()
    assert [(r["text"], r["jd_url"]) for r in out] == [("x &am©&notit;", "/x?a=1&b&lt")] * 2


def test_regular_pages_are_read_without_the_parser_and_alike():
    bits = ('<div class="base-card x">', "<table class='tbl wide'>", "<TR>", "</tr>", "<td>", "</td>", "</div>", "</a>", "a &amp; b",
            '<h3 class="base-search-card__title">', '<h4 class="base-search-card__subtitle">', "<a href='x?y=1&amp;z' class=\"k\">",
            '<a class="base-card__full-link" href="/j">', "&eacute;", " ", "<br>", "</table>", "<input disabled>")
    rnd, regular = random.Random(3), 0
    for layout in (G.LISTING_FULL, G.SPONSOR_ROW):
        plan = G._Plan(layout)
        for _ in range(300):
            html = "".join(rnd.choices(bits, k=rnd.randint(1, 40)))
            whole = G._Cards(plan)
            G._Irregular(whole).run(html)
            assert G._read(html, lambda: G._Cards(plan)).cards == whole.cards
            regular += bool(whole.cards)
    assert regular > 100
    with mock.patch.object(G._Irregular, "run", side_effect=AssertionError("parsed")):
        assert len(G._read(CARD, lambda: G._Cards(G._Plan(G.Layout("div.base-card", ())))).cards) == 1


def test_stream_batches_look_up_their_files_without_a_job(spark, tmp_path):
    from leadloom.session import listed_on_driver
    for n in range(40):
        (tmp_path / f"in/f{n}").mkdir(parents=True)
        (tmp_path / f"in/f{n}/metadata.json").write_text(f'{{"job_id": {n}}}')
    key, seen = "spark.sql.sources.parallelPartitionDiscovery.threshold", []
    before = spark.conf.get(key)
    with listed_on_driver(spark, 40):
        (T.stream_metadata(spark, str(tmp_path / "in"), max_files=40).writeStream
         .foreachBatch(lambda batch, _: seen.append((batch.count(), spark.conf.get(key))))
         .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination())
    assert seen == [(40, "40")] and spark.conf.get(key) == before


def test_payloads(spark):
    mail = {"data": {"emails": [
        {"first_name": "Ann", "last_name": "", "position": None, "value": "a@x"},
        {"first_name": "No", "last_name": "Mail", "position": "CTO", "value": ""},
        {"last_name": "Lee", "position": "Recruiter", "value": "l@x"}]}}
    people = {"people": [{"name": "P", "email": vocab.LOCKED_EMAIL, "title": "HR"},
                         {"name": "Q", "email": "q@x", "title": "CTO"}, {"name": "R"}]}
    df = spark.createDataFrame([(1, json.dumps(mail), json.dumps(people)), (2, "{}", "bad")],
                               "job_id int, m string, p string")
    got = contacts_from_payload(df, "mail", "m").select("name", "email", "contact_type", "pos")
    assert sorted(tuple(r) for r in got.collect()) == [
        ("Ann", "a@x", "other", 0), ("Lee", "l@x", "hr", 2)]
    got = contacts_from_payload(df, "people", "p").select("name", "contact_type")
    assert [tuple(r) for r in got.collect()] == [("Q", "hiring_manager")]


def test_ids_and_migration(spark):
    df = spark.range(6)
    assert sorted(r[0] for r in T.select_by_ids(df, "1, 2,,3").collect()) == [1, 2, 3]
    base = spark.createDataFrame([], schemas.JOBS_BASE)
    out = T.migrate_schema(base)
    assert out.columns == schemas.JOBS.names and T.migrate_schema(out).columns == out.columns


def test_profile_files(spark, tmp_path):
    default = spark.createDataFrame([("fallback",)], "profile string")
    assert T.load_profile(spark, str(tmp_path / "none.txt"), default).first()[0] == "fallback"
    (tmp_path / "p.txt").write_text("line one\nline two", encoding="utf-8")
    assert T.load_profile(spark, str(tmp_path / "p.txt"), default).first()[0] == "line one\nline two"


def test_profile_text(spark):
    profile = {"contact": {"name": "N", "location": "L", "phone": "P", "email": "E", "linkedin": "I",
                           "github": "G"}, "summary": "S",
               "skills": [{"category": "B", "skills": "x"}, {"category": "A", "skills": "y"}],
               "experience": [{"title": "T", "company": "C", "start": "1", "end": "2",
                               "bullets": ["b1", "b2"]}],
               "projects": None, "education": [{"degree": "D", "school": "H", "location": "",
                                                "date": "9"}]}
    df = spark.createDataFrame([(profile,)], schemas.T.StructType(
        [schemas.T.StructField("p", schemas.PROFILE)]))
    assert df.select(profile_text("p")).first()[0] == (
        "N\nL | P | E | I\n\nSUMMARY\nS\n\nSKILLS\nB: x\nA: y\n\nEXPERIENCE\n"
        "\nT  |  C  |  1 – 2\n• b1\n• b2\n\nEDUCATION\nD — H (9)")


def test_metadata_folders(spark, tmp_path):
    for name, meta in (("a", {"job_id": 1, "applied_status": "applied"}), ("b", {"job_id": 2}),
                       ("c", None)):
        (tmp_path / name).mkdir()
        if meta:
            (tmp_path / name / "metadata.json").write_text(json.dumps(meta, indent=2))
    (tmp_path / "note.txt").write_text("x")
    got = T.read_metadata(spark, str(tmp_path)).select("job_id", "applied_status")
    assert sorted(map(tuple, got.collect())) == [(1, "applied"), (2, None)]


def test_metadata_patch_ignores_unknown_records(spark):
    meta = spark.createDataFrame([(1, "a", None), (2, "b", None)],
                                 "job_id int, applied_status string, updated_at string")
    delta = spark.createDataFrame([(2, "applied"), (9, "x")], "job_id int, applied_status string")
    out = K.metadata_patch(meta, delta, "2024-01-01 00:00:00")
    assert sorted(map(tuple, out.collect())) == [
        (1, "a", None), (2, "applied", "2024-01-01T00:00:00")]


def test_drafts_last_wins_and_missing_contact(spark):
    outreach = spark.createDataFrame([
        (1, 5, 7, "cold_email", None, "s1", "old", "draft"),
        (2, 5, 7, "cold_email", None, "s2", "new", "draft"),
        (3, 5, None, "cold_email", None, "s3", "x", "draft"),
        (4, 5, None, "followup", 3, "", "", "draft"),
        (5, 5, None, "referral_dm", None, "", "", "sent")],
        "id int, job_id int, contact_id int, outreach_type string, followup_day int, "
        "subject string, body string, status string")
    contacts = spark.createDataFrame([(7, "Ann", "a@x", "CTO", "hr")],
                                     "id int, name string, email string, title string, contact_type string")
    docs = {r["file_name"]: r["content"] for r in K.draft_documents(outreach, contacts).collect()}
    assert sorted(docs) == ["cold_email_None.txt", "cold_email_hr.txt", "followup_day3.txt",
                            "referral_dm_5.txt"]
    assert docs["cold_email_hr.txt"] == (
        "TO: a@x\nCONTACT: Ann (CTO)\nSUBJECT: s2\nSTATUS: draft\n" + "=" * 60 + "\n\nnew")
    assert docs["cold_email_None.txt"].startswith("TO: None\nCONTACT: None (None)\n")


def test_exports_round_trip(spark, tmp_path):
    jobs = spark.createDataFrame(
        [(1, "c", "r", "u", "s", "l", True, "pending", None, "2024-01-01 00:00:00"),
         (2, "d", "r", "v", "s", "l", None, "applied", "2024-01-03", "2024-01-02 00:00:00")],
        "id int, company string, role string, jd_url string, source string, location string, "
        "h1b_confirmed boolean, applied_status string, applied_at string, created_at string")
    out = K.export_jobs(jobs, headers=True)
    assert out.columns == list(vocab.EXPORT_HEADERS)
    assert [(r["ID"], r["H1B Confirmed"], r["Applied At"]) for r in out.collect()] == [
        (2, "No", "2024-01-03"), (1, "Yes", "")]
    K.write_export(out, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    path = T.write_version(out.withColumnRenamed("ID", "id").select("id"), str(tmp_path), "t", "v1")
    assert spark.read.parquet(path).count() == 2
    snap = K.snapshot_documents(spark.createDataFrame(
        [(1, "x"), (2, ""), (3, None)], "id int, description string"))
    assert [r["job_id"] for r in snap.collect()] == [1]


def test_read_table_uses_declared_schema(spark, tmp_path):
    spark.createDataFrame([], schemas.CONTACTS).write.parquet(str(tmp_path / "contacts"))
    assert T.read_table(spark, str(tmp_path), "contacts").schema == schemas.CONTACTS


def test_damaged_and_missing_metadata(spark, tmp_path):
    from leadloom.sources.tables import scan_metadata, stream_metadata

    files = {"good": '{"job_id": 1, "applied_status": "applied",\n "extra": [1, 2]}', "cut": '{"job_id": 2, "company": "c',
             "empty": "", "array": "[]", "text": "no json", "typed": '{"job_id": "x", "company": "C"}', "none": "{}",
             "utf": '{"job_id": 9, "company": "Ünï"}'}
    for name, text in files.items():
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "metadata.json").write_text(text, encoding="utf-8")
    (tmp_path / "in" / "bare").mkdir()
    (tmp_path / "in" / "good" / "other.json").write_text("{}")
    found = scan_metadata(spark, str(tmp_path / "in"))
    rows = {r["file"].split("/")[-2]: r for r in found.collect()}
    del files["empty"]  # holds no record
    assert sorted(rows) == sorted(files)
    assert {n for n, r in rows.items() if not r["damaged"]} == {"good", "utf"}
    assert (rows["good"]["job_id"], rows["utf"]["company"], rows["typed"]["company"]) == (1, "Ünï", "C")

    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        stream = stream_metadata(spark, str(tmp_path / "in"), max_files=3)
        (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start().awaitTermination())
        return spark.read.schema(stream.schema).parquet(out)

    assert sorted(map(str, run().collect())) == sorted(map(str, found.collect()))
    (tmp_path / "in" / "late").mkdir()
    (tmp_path / "in" / "late" / "metadata.json").write_text('{"job_id": 77}')
    assert run().count() == len(files) + 1


def test_prompts_cut_texts_before_the_join(spark):
    from leadloom.functions.render import slot_limit
    from leadloom.operators.outreach import EMAILS, prompt_table

    assert slot_limit("profile", *EMAILS) == 2000 and slot_limit("profile", "bullets", "letter") is None
    jobs = spark.createDataFrame([(1, "c", "r", "d" * 5000, "v")], "id long, company string, role string, description string, variant string")
    people = spark.createDataFrame([(1, 7, "Ann B", "HR")], "job_id long, id long, name string, title string")
    profiles = spark.createDataFrame([("v", "p" * 9000), ("w", "q")], "variant string, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = prompt_table(jobs, people, profiles, "S")
        plan = made._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joined = plan[plan.index("Join"):]
    assert "substring(text" in joined and ", 1, 2000)" in joined and ", 1, 600)" in joined
    prompt = made.first()["prompt"]
    assert prompt.count("p" * 2000) == 1 and "p" * 2001 not in prompt and "d" * 601 not in prompt


def test_metadata_folders_are_listed_by_few_tasks(spark):
    from leadloom.plans.catalog import QUERIES
    base, key = "/root/testdata/sf0.01", "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    pages = spark.read.parquet(f"{base}/pages.parquet").where("page_id % 7 <> 0").count()
    before, track = spark.conf.get(key), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("folders", "listing and writing of metadata folders")
    try:
        assert QUERIES["metadata_folders"](spark, base).count() == pages
        stages = [track.getStageInfo(s) for j in track.getJobIdsForGroup("folders") for s in track.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert spark.conf.get(key) == before
    assert pages > 200 and max(s.numTasks for s in stages if s) < pages / 2


def folder_pages(spark, base):
    """A table of pages under ``base``, some of them twice or without a number, and the numbers that get a folder."""
    ids = [*range(300), *range(0, 300, 50), None]
    rows = [(n, f"http://h.example/{n}?a=\"é\"", "<p>x</p>") for n in ids]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{base}/pages.parquet")
    return [n for n in range(300) if n % 7]


def stages_of(spark, run):
    """What ``run`` returns, and the number of tasks of every stage that ended meanwhile, in whatever thread."""
    track, last = spark.sparkContext.statusTracker(), []
    for step in (lambda: None, run):
        out = step()
        spark.sparkContext.setJobGroup("last", "a job that tells the next stage")
        spark.range(1).rdd.count()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        last.append(max(s for j in track.getJobIdsForGroup("last") for s in track.getJobInfo(j).stageIds))
    found = [track.getStageInfo(s) for s in range(last[0] + 1, last[1])]
    return out, [s.numTasks for s in found if s]


def test_folders_are_put_in_place_as_spark_would(spark, tmp_path):
    names = ["folder_1", "folder_1", "folder_-2", "a=b/c d%\"é^", "", None, "folder_3"]
    values = ['{"a": 1}', "two\nlines", None, "é", "e", "n", ""]
    rows = spark.createDataFrame([*zip(names, values)], "folder string, value string")
    K.write_folders(rows, str(tmp_path / "own"), 4)
    rows.repartition(4, "folder").write.partitionBy("folder").text(str(tmp_path / "spark"))

    def files(top):
        found = [f for f in (tmp_path / top).rglob("*") if f.is_file() and not f.name.startswith(("_", "."))]
        assert all(re.fullmatch(r"part-\d+.*\.txt", f.name) for f in found)
        return sorted((f.parent.name, sorted(f.read_bytes().split(b"\n"))) for f in found)

    assert files("own") == files("spark") and len(files("own")) >= 5
    assert not [f for f in (tmp_path / "own").rglob(".*")]  # nothing half done, and no second file made for each
    with pytest.raises(FileExistsError):
        K.write_folders(rows, str(tmp_path / "own"), 4)
    K.write_folders(rows.limit(0), f"file://{tmp_path}/none", 4)
    assert T.scan_metadata(spark, str(tmp_path / "none"), "part-*.txt").count() == 0


def test_folders_in_a_store_that_only_spark_reaches(spark, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.folders.link./out", f"file://{tmp_path}")
    rows = spark.createDataFrame([("f1", "x"), ("f2", "y")], "folder string, value string")
    K.write_folders(rows, "viewfs://folders/out/t", 2)
    back = spark.read.text("viewfs://folders/out/t")
    assert sorted((r["folder"], r["value"]) for r in back.collect()) == [("f1", "x"), ("f2", "y")]


def test_metadata_folders_are_read_in_few_tasks(spark, tmp_path):
    from leadloom.plans.catalog import QUERIES
    wanted, key = folder_pages(spark, tmp_path), "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "16m")  # four files a task, by Spark's count
    try:
        out = QUERIES["metadata_folders"](spark, str(tmp_path))
        assert out.rdd.getNumPartitions() == len(wanted) // T.FILES_A_TASK == 2
        got = sorted(tuple(r) for r in out.collect())
    finally:
        spark.conf.set(key, before)
    status = ["applied", "pending", None]
    assert got == sorted((f"folder_{n}", n % 5 == 0, n if n % 5 else None, status[n % 3] if n % 5 else None)
                         for n in wanted)


def test_metadata_stream_lists_its_folders_in_few_tasks(spark, tmp_path):
    from leadloom.plans.catalog import QUERIES
    from leadloom.plans.catalog_tables import FOLDER_TASKS
    wanted = folder_pages(spark, tmp_path)
    keys = ["spark.sql.files.openCostInBytes", "spark.sql.sources.parallelPartitionDiscovery.parallelism"]
    before = [spark.conf.get(k) for k in keys]
    out, tasks = stages_of(spark, lambda: QUERIES["metadata_folders_stream"](spark, str(tmp_path)))
    assert len(wanted) > 2 * FOLDER_TASKS and len(tasks) >= 5 and max(tasks) == FOLDER_TASKS
    good = [n for n in wanted if n % 5]
    applied = sum(n % 3 == 0 for n in good)
    assert sorted(map(tuple, out.collect())) == [("applied", applied), ("pending", len(good) - applied)]
    assert [spark.conf.get(k) for k in keys] == before
