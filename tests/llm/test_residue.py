import pytest

from quire.llm.residue import find_residue, residue, without_residue

HEAD = "commit {0}\nAuthor: A B <a@b.test>\nDate:   Wed Oct 8 07:57:18 2025 +0800\n\n".format("a" * 40)
DIFF = "\ndiff --git a/x.md b/x.md\nindex 1..2 100644\n--- a/x.md\n+++ b/x.md\n@@ -1,2 +1,3 @@\n a\n+{line}\n-b\n"


def commit(*message, line="c", end=""):
    return HEAD + "".join(f"    {m}\n" for m in message) + DIFF.format(line=line) + end


@pytest.mark.parametrize(
    "text, kind",
    [
        (commit("Update {{ version }} to ${scope}"), "placeholder"),
        (commit("[[[VERSION]]] null"), "placeholder"),
        (commit("fix(<REVIEWER>): $description"), "placeholder"),
        (commit("Fix x", "", "Reviewed-by: %(issue.key)s"), "placeholder"),
        (commit("Fix x").replace("A B <a@b.test>", "{author} <{email}>"), "placeholder"),
        (commit("Fix x", "", "## What", "Describe your change here"), "prompt"),
        (commit("请在这里输入修改内容"), "prompt"),
        (commit("[short description of the change]"), "prompt"),
        (commit("<!-- Please explain what this commit does -->"), "prompt"),
        (commit("Lorem ipsum aliqua labore velit culpa tempor sit"), "filler"),
        (commit("sjswwfkr qwerty qwerty"), "filler"),
        (commit("test test test"), "filler"),
        (commit("testing testing testing 1 2 3"), "filler"),
        (commit("XXXXXXXXXXXXXX"), "filler"),
        (commit("yada yada yada"), "filler"),
        (commit("foo bar foo bar foo bar"), "filler"),
        (commit("Platzhaltertext Platzhaltertext"), "filler"),
        (commit("????????????"), "filler"),
        (commit("---------------"), "filler"),
        ("\ufeff0123456789ab\t{author}\t2024-01-01T00:00:00Z\nFix x\n", "placeholder"),
        (commit("Fix x", "", "----------", "More words here"), None),
        (commit("Fix fix of the fix"), None),
        (commit("Content coming soon", "", "Inhalt folgt."), "filler"),
        (commit("Fix x", end="Sorry, this diff could not be loaded. Reload to try again.\n"), "error"),
        (commit("Fix x", end="<noscript>You need to enable JavaScript to run this app.</noscript>\n"), "scripts"),
        (HEAD + "    Fix x\n\nHTTP/1.1 502 Bad Gateway\ncontent-type: text/plain\n", "error"),
        ("Fehler 502: Die angeforderte Seite konnte nicht geladen werden.\nVorgang 29eb81a6b98b", "error"),
        ('{"message": "Too Many Requests", "status": 429, "request_id": "7ecc8171a1a7"}', "error"),
        ("<html>\n<head><title>403 Forbidden</title></head>\n<body></body>\n</html>", "error"),
        ("Traceback (most recent call last):\n  File \"v.py\", line 5, in show\nE: x", "error"),
        ("JavaScript を有効にしてください。", "scripts"),
        ("Loading…\n\nIf nothing happens, your browser blocks scripts.\n", "scripts"),
        # real messages that talk about such words, changed lines, terse and automatic messages
        (commit("Stop sending `{{what_changed}}` in mail subjects"), None),
        (commit("Return 404 Not Found for unknown ids", "", "It was an Internal Server Error before, which paged people at night."), None),
        (commit("Show our own page on 502 Bad Gateway in ko", "", "The proxy page confused readers."), None),
        (commit("Replace lorem ipsum in the mock-up with real copy"), None),
        (commit("test: seed hebek with filler text"), None),
        (commit("Add noscript hint to wawon", "", "Readers without scripts saw a blank page."), None),
        (commit("Add commit template", line="# Describe your change here"), None),
        (commit("Fix x", line="Hello {{ name }}, your order ${title} is ready"), None),
        (commit("wip"), None),
        (commit("."), None),
        (commit("Merge branch 'main' of x.example:a/b", "", "# Conflicts:", "#\ttests/x.py"), None),
        (commit("[peilo-bot] refresh lock file"), None),
        (commit("chore(release): 1.2.3 [skip ci]"), None),
        (commit("Fix crash", "", "Traceback (most recent call last):"), None),
        ("", None),
        (None, None),
        (" \n\t", None),
        (commit("Fix x", line="y" * 300_000), None),
    ],
)
def test_residue(text, kind):
    assert residue(text) == kind


@pytest.mark.parametrize(
    "subject",
    [
        "Use ${HOME} in the install script", "Replace {{ name }} with {{ title }} in the header template", "Escape %(user)s in the log format", "Read $(pwd) once, not per file", "Support [[wiki links]] in the parser",
        "Fix «quoted» titles in the French locale", "Rename #{title} interpolation helper", "Handle <title> in feeds", "Handle connection refused", "Fix page not found", "Return 404 Not Found for unknown ids",
        "Retry when the service is unavailable", "Translate page not found to Korean", "Show access denied in the log", "Document how to enable JavaScript in tests", "Drop the coming soon banner", "Add description", "Add your avatar to the profile page",
        "Parse [title](url) links in the changelog", "Interpolate $version before $date in file names", "Allow {path} in %TEMP% settings on Windows", "Rename first name to given name", "Fehler in der Fußzeile behoben", "修复页面不存在时的错误", "Store null instead of undefined for empty titles",
    ],
)
def test_real_subjects_are_clean(subject):
    assert residue(commit(subject)) is None and residue(commit(subject, "", "It broke on Mondays.")) is None


@pytest.mark.parametrize(
    "text",
    [
        "This page requires JavaScript to be enabled", "HTTP Error 503. The service is unavailable.", "[INSERT TITLE HERE]", "Add your description here", "Страница не найдена", "페이지를 찾을 수 없습니다", "Pagina non trovata. Riprova più tardi.", "Ha ocurrido un error. Inténtelo de nuevo más tarde.",
        "Es ist ein Fehler aufgetreten", "Включите JavaScript, чтобы продолжить", "자바스크립트를 활성화 하세요", "Abilita JavaScript per continuare", "Enter your commit message here", "{{ anything.at_all }}", "We're sorry, an error occurred while processing your request.", "The requested URL was not found on this server.",
        "You must enable JavaScript to continue", "JavaScript is turned off", "Testo segnaposto", "${PROJECT_NAME}",
    ],
)
def test_residue_that_no_generator_wrote(text):
    assert residue(text) is not None


@pytest.mark.parametrize("author", ["Your Name <you@example.invalid>", "FIRSTNAME LASTNAME <name@company.invalid>", "%USER_NAME%", "{author} <{email}>", "Ihr Name <x@y.test>"])
def test_authors_left_unfilled(author):
    assert residue(commit("Fix x").replace("A B <a@b.test>", author)) == "placeholder"
    assert residue(commit("Fix x").replace("A B", "Johannes Namer")) is None


def test_coverage_is_of_the_whole_text_that_is_no_commit():
    assert residue("Hello,\nwe are sorry\nan unexpected error\nbad gateway\nplease try again later\n") == "error"
    long = "A chapter about proxies.\n" * 200
    assert residue(long + "Access denied is what the proxy of the old house said to all of us.\n") is None


def test_operator(spark, rows):
    data = [(1, "Access denied", "k"), (1, "Access denied", "k"), (2, None, "k"), (3, "", "k"), (4, commit("Fix x"), "k")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, kind string")
    assert rows(find_residue(df, "doc_id")) == [(1, "error")] * 2
    assert sorted(r.doc_id for r in without_residue(df).collect()) == [2, 3, 4]
    assert find_residue(df.limit(0), "doc_id").count() == 0 == without_residue(df.limit(0)).count()
    assert without_residue(df).schema == df.schema
    plan = without_residue(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
