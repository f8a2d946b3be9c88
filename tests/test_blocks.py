import json

from pagelake.sources import blocks as B

EXA_TEXT = ("Title: First\nURL: https://a.example\nPublished date: 2024\nHighlights:\nline one\nline two\n---\n"
            "Title: No url here\nsome text\n---\n"
            "Title: Second\nURL: https://b.example\nAuthor: x\nonly line")


def test_exa_blocks(spark):
    payload = json.dumps({"result": {"content": [{"type": "text", "text": EXA_TEXT}, {"type": "image", "text": "x"}]}})
    body = f"event: message\ndata: \ndata: {payload}\n"
    raw = spark.createDataFrame([("q", body)], "query_id string, body string")
    got = [(r.rank, r.title, r.url, r.description, r.content) for r in B.exa_results(raw, 5).orderBy("rank").collect()]
    assert got == [(1, "First", "https://a.example", "line one", "line one\nline two"),
                   (2, "Second", "https://b.example", "only line", "only line")]
    assert B.exa_results(raw, 1).count() == 1


def test_grep_blocks(spark):
    block = ("Repository: org/repo\nPath: src/a.go\nURL: https://x/org/repo/a.go\nSnippets:\n"
             "--- Snippet 1 (Line 40) ---\n\n  func Foo() {\n    return NewThing()\n--- Snippet 2 (Line 90) ---\nmore")
    msg = {"result": {"content": [{"type": "text", "text": block},
                                  {"type": "text", "text": "Path: only/path\nno repo"}], "isError": False}}
    body = "data: not json\ndata: " + json.dumps(msg) + "\n"
    err = "data: " + json.dumps({"error": {"code": 1, "message": "boom"}}) + "\n"
    raw = spark.createDataFrame([("q1", body), ("q2", err)], "query_id string, body string")
    rows = {r.query_id: r for r in B.grep_block_results(raw, "newthing", 10, "go").collect()}
    r = rows["q1"]
    assert (r.repo, r.path, r.line_no, r.snippet) == ("org/repo", "src/a.go", 42, "return NewThing()")
    assert rows["q2"].error == "grep error: boom"


def test_sourcegraph_and_github(spark):
    m = [{"type": "content", "repository": "gh/x", "path": "a.py", "language": "Python", "repoStars": 5,
          "lineMatches": [{"line": "def f():", "lineNumber": 3}]},
         {"type": "repo", "repository": "gh/y", "path": "", "lineMatches": []}]
    body = "event: progress\ndata: {}\nevent: matches\ndata: " + json.dumps(m) + "\nevent: done\ndata: []\n"
    raw = spark.createDataFrame([("q", body)], "query_id string, body string")
    got = B.sourcegraph_results(raw, 10).collect()
    assert len(got) == 1 and got[0].url == "https://sourcegraph.com/gh/x/-/blob/a.py#L3" and got[0].stars == 5
    gh = {"total_count": 1, "items": [{"path": "p.go", "html_url": "https://gh/p.go",
                                       "repository": {"full_name": "o/r", "html_url": "", "node_id": "N1"},
                                       "text_matches": [{"fragment": "a\nfind(me)\nz",
                                                         "matches": [{"indices": [3, 7], "text": "find"}]}]}]}
    raw = spark.createDataFrame([("q", json.dumps(gh))], "query_id string, body string")
    r = B.github_results(raw, 30).first()
    assert (r.repo, r.snippet, r.node_id) == ("o/r", "find(me)", "N1")


def test_docs(spark):
    d = {"codeSnippets": [{"codeTitle": "Install", "codeId": "https://d/1", "codeList": [{"language": "sh",
                                                                                         "code": "pip install x"}]},
                          {"codeTitle": "Empty", "codeId": "https://d/2", "codeList": []}],
         "infoSnippets": [{"pageId": "https://d/p", "breadcrumb": "Guide > Start", "content": "Read me"}]}
    raw = spark.createDataFrame([("/lib/x", json.dumps(d))], "library string, body string")
    got = [(r.pos, r.title, r.breadcrumb, r.snippet) for r in B.docs_results(raw).orderBy("pos").collect()]
    assert got == [(0, "Install", None, "pip install x"), (1, "Empty", None, ""),
                   (2, "Guide > Start", "Guide > Start", "Read me")]


def test_query_docs_and_library_matches(spark):
    from pagelake.plans.composite import query_docs
    from pagelake.sources.payloads import library_matches
    matches = {"results": [{"id": f"/lib/{i}", "title": f"L{i}", "description": "", "totalSnippets": i,
                            "trustScore": 7.5, "versions": ["v1"]} for i in range(20)]}
    raw = spark.createDataFrame([("q", json.dumps(matches))], "query_id string, body string")
    assert library_matches(raw, 3).count() == 3 and library_matches(raw, 0).count() == 20
    docs = {"codeSnippets": [{"codeTitle": "T", "codeId": "u", "codeList": [{"language": "x", "code": "c"}]}],
            "infoSnippets": []}
    draw = spark.createDataFrame([("/lib/0", json.dumps(docs)), ("/lib/1", json.dumps(docs))], "library string, body string")
    got = query_docs(raw, draw).collect()
    assert [(r.query_id, r.library, r.title, r.snippet) for r in got] == [("q", "/lib/0", "T", "c")]
