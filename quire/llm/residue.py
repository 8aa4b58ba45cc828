"""Template residue, filler, error pages and demands for scripts in the place of real content.

A document is cut into the parts in which such text can stand for content: the author, the message and
its lines, and lines of a diff that no patch has (a failed download leaves its error there). Changed and
context lines, binary patches and file headers are left alone: words there are data. One automaton finds
phrases in several languages, and template fields in every kind of brackets, over each part at once. A
document is residue when what is matched covers enough of one part: of the whole text, the message, a
line, the author or the tail. A message that talks about an error or a template in its own words doesn't.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of a part's letters that matches must cover, by kind: in a commit (a text with a header or a
#: diff), whose message may well name an error or a script, and in a text that is no commit.
COVERAGE = {
    "error": (0.82, 0.5), "scripts": (0.75, 0.5), "prompt": (0.6, 0.5), "filler": (0.55, 0.5), "latin": (0.6, 0.6), "keys": (0.35, 0.35), "trace": (2.0, 0.5),
    "placeholder": (0.5, 0.5), "person": (0.6, 2.0),
}
#: Share that template fields must cover when no word follows the last one: the slot at a line's end.
AT_END = 0.29

# Phrases by kind, in lower case.
PHRASES = {
    "error": [
        "the server at", "could not answer", "request id", "upstream connect error or disconnect before headers", "reset reason", "content-type: text/plain",
        "page not found", "this repository does not exist or you have no access to it", "we could not find the commit you are looking for", "it may have been deleted or moved",
        "this page does not exist", "the page you requested could not be found", "the page you are looking for", "could not be found", "access denied", "permission denied", "you do not have permission",
        "your address has sent too many requests to", "rate limit exceeded", "site under maintenance", "under maintenance", "will be back at", "is down for maintenance", "temporarily unavailable",
        "oops! something went wrong", "something went wrong", "on our side", "please try again in a few minutes", "please try again later", "an error occurred", "an error has occurred", "an unexpected error",
        "sorry, this diff could not be loaded", "reload to try again", "unable to show the changes", "the request timed out", "failed to load", "could not be loaded", "unable to load",
        "your session has expired", "sign in again to see this commit", "please log in to continue", "please sign in", "you must be logged in", "cannot render commit page", "templateerror", "connection refused", "connection timed out",
        '{"message": "', '"status": ', '"request_id": ', '"error": ', '"code": ',
        "fehler", "die angeforderte seite konnte nicht geladen werden", "konnte nicht geladen werden", "seite nicht gefunden", "zugriff verweigert", "ein fehler ist aufgetreten", "bitte versuchen sie es später erneut", "vorgang",
        "erreur", "la page demandée est introuvable", "page introuvable", "accès refusé", "une erreur est survenue", "veuillez réessayer plus tard",
        "no se pudo cargar la página", "vuelva a intentarlo", "página no encontrada", "acceso denegado", "ha ocurrido un error", "se ha producido un error",
        "não foi possível carregar a página", "página não encontrada", "acesso negado", "ocorreu um erro", "tente novamente", "erro",
        "您访问的页面不存在或已被删除", "错误", "编号", "服务器繁忙", "请稍后再试", "抱歉", "页面不存在", "页面未找到", "访问被拒绝", "出错了", "无法加载",
        "http error", "the service is unavailable", "the service is temporarily unavailable", "the requested url was not found on this server", "internal server error", "bad gateway", "gateway timeout", "this page isn't working", "this site can't be reached", "we're sorry", "an error occurred while processing your request", "the server encountered an internal error",
        "die seite wurde nicht gefunden", "die seite konnte nicht gefunden werden", "der dienst ist nicht verfügbar", "es ist ein fehler aufgetreten", "zugriff nicht erlaubt", "la page n'existe pas", "service indisponible", "accès interdit", "une erreur s'est produite", "la página no existe", "no se encontró la página", "servicio no disponible", "inténtelo de nuevo más tarde", "a página não existe", "serviço indisponível", "tente novamente mais tarde",
        "pagina non trovata", "la pagina richiesta non esiste", "accesso negato", "si è verificato un errore", "servizio non disponibile", "riprova più tardi", "pagina niet gevonden", "er is een fout opgetreden", "toegang geweigerd",
        "страница не найдена", "доступ запрещён", "доступ запрещен", "произошла ошибка", "ошибка сервера", "сервис временно недоступен", "попробуйте позже", "повторите попытку позже", "strona nie została znaleziona", "wystąpił błąd", "odmowa dostępu", "sayfa bulunamadı", "erişim engellendi",
        "페이지를 찾을 수 없습니다", "접근이 거부되었습니다", "오류가 발생했습니다", "잠시 후 다시 시도해 주세요", "서비스를 사용할 수 없습니다", "الصفحة غير موجودة", "تم رفض الوصول",
        "ページが見つかりません", "エラーが発生しました", "アクセスが拒否されました", "しばらくしてからもう一度お試しください", "読み込めませんでした",
    ],
    "status": [
        "bad request", "unauthorized", "authorization required", "payment required", "forbidden", "not found", "method not allowed", "request timeout", "gone", "too many requests", "internal server error", "bad gateway",
        "service unavailable", "service temporarily unavailable", "gateway time-out", "gateway timeout",
    ],
    "scripts": [
        "please enable javascript", "to view this page", "you need to enable javascript", "to run this app", "enable javascript", "javascript is disabled in your browser", "the commit view cannot be shown without it", "javascript is required", "requires javascript",
        "this site works only with js switched on", "works only with js", "needs scripts to run", "turn them on and reload", "your browser blocks scripts", "if nothing happens", "checking your browser before you reach", "this check requires scripts and cookies", "turn on javascript", "activate javascript", "enable scripts",
        "bitte aktivieren sie javascript", "um diese seite anzuzeigen", "javascript aktivieren", "veuillez activer javascript", "pour afficher ce commit", "activez javascript", "habilite javascript", "para ver el historial", "active javascript", "active o javascript", "ative o javascript", "habilite o javascript",
        "this page requires javascript", "to be enabled", "requires javascript to be enabled", "this app requires javascript", "you must enable javascript", "javascript must be enabled", "javascript is disabled", "javascript is turned off", "enable cookies", "to continue", "please turn javascript on", "please wait while we verify your browser",
        "aktiviere javascript", "aktivieren sie javascript", "javascript muss aktiviert sein", "diese seite benötigt javascript", "diese seite erfordert javascript", "javascript est désactivé", "cette page nécessite javascript", "activer javascript", "habilitar javascript", "activar javascript", "active javascript en su navegador", "esta página requiere javascript", "esta página necesita javascript", "ativar javascript", "habilitar o javascript",
        "abilita javascript", "attiva javascript", "questa pagina richiede javascript", "schakel javascript in", "включите javascript", "для работы сайта необходим javascript", "javascript отключён", "włącz obsługę javascript", "javascript'i etkinleştirin", "javascript를 활성화", "자바스크립트를 활성화", "이 페이지를 보려면", "하세요", "해 주세요",
        "请启用 javascript", "请启用javascript", "后重新加载页面", "启用 javascript", "javascript を有効にしてください", "javascriptを有効にしてください",
    ],
    "prompt": [
        "tell us what changed", "what does this change do?", "please describe your changes", "please fill in", "to be filled in", "delete this line", "remove this line before submitting", "inserire qui la descrizione", "введите описание", "опишите изменения", "설명을 입력하세요", "여기에 입력",
        "describe your change here", "describe your changes here", "insert summary here", "type the details of the change below", "write a meaningful title", "please explain what this commit does", "short description of the change", "one-line description",
        "todo: commit message", "name of the person who reviewed", "subject line (max", "chars)", "why is this change needed?", "(fill in)", "replace this text with a short description", "your message here", "commit message here", "enter the commit message", "please enter the commit message", "add a description", "insert description here", "your text here", "your name here",
        "hier beschreibung eintragen", "kurzbeschreibung einfügen", "beschreibung einfügen", "décrivez ici la modification", "insérez un résumé", "escriba aquí la descripción", "describa aquí el cambio", "descreva aqui a alteração", "insira um resumo",
        "此处填写提交说明", "请在这里输入修改内容", "请填写", "在此输入", "ここに変更内容を記入", "ここに説明を入力",
    ],
    "filler": [
        "testo segnaposto", "contenuto in arrivo", "здесь будет текст", "текст-заполнитель", "скоро здесь появится", "tekst zastępczy", "곧 제공될 예정입니다", "자리 표시자 텍스트",
        "content coming soon", "coming soon", "text to follow", "body to be supplied", "to be supplied", "sample text goes here", "text goes here", "this is a placeholder", "placeholder text", "it will be replaced later", "filler text", "dummy text", "to be announced", "to be written",
        "inhalt folgt", "text folgt", "dies ist ein blindtext", "blindtext ohne inhalt", "blindtext", "platzhaltertext", "ohne inhalt", "contenu à venir", "texte à venir", "texte fictif", "contenido próximamente", "texto de relleno", "texto de ejemplo", "conteúdo em breve", "texto de exemplo",
        "占位文本", "占位符", "示例文本", "内容待补充", "敬请期待", "ダミーテキスト", "準備中",
    ],
    "latin": (
        "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat "
        "duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
    ).split(),
    "keys": ["qwerty", "qwertz", "azerty", "asdf", "asdfg", "asdfgh", "sdfg", "jkl", "hjkl", "jklö", "zxcv", "zxcvb", "dfgh", "fghj", "uiop", "foo bar baz", "blah blah", "bla bla", "foobar"],
    "trace": ["traceback (most recent call last)"],
    "person": ["your name", "firstname lastname", "first name last name", "first last", "full name", "name surname", "your full name", "you@", "your.name@", "your.email@", "youremail@", "name@company", "user@domain", "email@example", "name@example", "vorname nachname", "ihr name", "prénom nom", "nombre apellido", "nome cognome", "nome sobrenome", "имя фамилия", "姓名", "你的名字", "名前"],
}

# Names that templates give to their fields, in parts, and the brackets they stand in.
FIELDS = (
    "title summary subject description desc scope reason why ticket ticket-id issue issue-id issue-key jira jira-key component module version release release-notes notes changelog reviewer reviewers "
    "author author-name author-email name email user user-name user-email username message commit-message commit msg body type change-type what-changed change changes date branch tag hash "
    "short-description one-line-summary git-author-name git-author-email committer committer-name project project-name repo repository url link placeholder content text first-name last-name firstname lastname company details"
).split()
BRACKETS = ["{{ }}", "${ }", "$( )", "<%= %>", "<% %>", "%{ }", "%( )s", "@@ @@", "[[ ]]", "#{ }", "« »", "__ __", "% %", "{ }", "< >", "[ ]", "$ "]
#: Words that stand where a field had no value; matched beside a field only.
UNFILLED = re.compile(r"\b(?:undefined|null|none|nan|nil)\b", re.I)
#: A line that is one field of any name, in brackets that nothing else has.
FIELD = re.compile(r"(?:\{\{[^{}]+\}\}|\$\{[^{}]+\}|\$\([^()]+\)|<%[^%]+%>|%\{[^{}]+\}|%\([^()]+\)s|@@[^@\s]+@@|\[\[[^\[\]]+\]\]|#\{[^{}]+\}|«[^«»]+»|\[insert[^\[\]]*\]|<insert[^<>]*>)", re.I)
QUOTED = re.compile(r"`[^`\n]*`|\"[^\"\n]*\"|“[^”\n]*”")
#: A word or two, or a letter, again and again; test twice more is enough with a count behind it.
REPEATED = re.compile(r"\W*(?:(?P<w>\w+(?: \w+)?)(?:[\s,.;，、]+(?P=w)){2,}(?:[\s,]+\d+)*|(?P<l>[^\W\d_])(?P=l){5,}|(?:[xX]{3,}\s*){2,})\W*", re.I)
#: One mark again and again: filler wherever it stands, or only as the subject, as some draw lines.
MARKS, RULES = re.compile(r"([?…!])\1{5,}"), re.compile(r"([-=*_.#~/])\1{5,}")
TAG = re.compile(r"<[^<>]*>")

_DIFF = re.compile(r"^diff --git ", re.M)
_HEADER = re.compile(r"(?:commit [0-9a-f]{7,40}\b.*|From [0-9a-f]{7,40} .*|Date: .*|Merge: [0-9a-f .]+|Showing \d+ changed files?|index [0-9a-f]+.*|---|--\s*|\W*)")
_AUTHOR = re.compile(r"(?:Author|From|Commit):\s+(?P<a>(?![0-9a-f]{40} ).*)|[0-9a-f]{7,40}\t(?P<b>[^\t]*)\t.*|(?P<c>.+) committed \d{4}-\d\d-\d\d.*")
_LOOSE = re.compile(
    r"^(?![-+ @\\\s]|diff --git |index [0-9a-f]|new file mode|deleted file mode|old mode|new mode|similarity index|dissimilarity index|rename (?:from|to)|copy (?:from|to)|GIT binary patch|(?:literal|delta) \d+$|Binary files |[A-Za-z](?:[0-9A-Za-z!#$%&()*+;<=>?@^_`{|}~-]{5}){1,13}\r?$).+$",
    re.M,
)
_STATUS = re.compile(r"(?:[45]\d\d\W{1,3}|\")$")


NAMED = {"latin": "filler", "keys": "filler", "trace": "error", "person": "placeholder"}


def fields() -> Iterator[str]:
    """Template fields as they are written, in lower case."""
    for name, bracket in product(FIELDS, BRACKETS):
        parts, (opening, closing) = name.split("-"), bracket.split(" ")
        for joint in ("-", "_", ".", " ", "") if len(parts) > 1 else ("",):
            word = joint.join(parts)
            yield f"{opening}{word}{closing}"
            if closing and opening not in ("__", "%", "<", "[", "@@"):
                yield f"{opening} {word} {closing}"


def requests() -> Iterator[str]:
    """Requests to fill a field in."""
    for name in FIELDS:
        word = name.replace("-", " ")
        yield from (f"{verb} {article}{word} here" for verb in ("insert", "enter", "add", "type", "write", "put") for article in ("", "a ", "the ", "your "))
        yield from (f"your {word} here", f"{word} goes here", f"enter your {word}", f"insert your {word}")


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, phrases in [*PHRASES.items(), ("prompt", requests()), ("placeholder", fields())]:
        for p in phrases:
            if not a.exists(p):
                a.add_word(p, (len(p), kind))
    for p in PHRASES["status"]:  # a number before them makes them an error by themselves
        a.add_word(p, (len(p), "status"))
    a.make_automaton()
    return a


def word_at(low: str, k: int) -> bool:
    return 0 <= k < len(low) and low[k].isalnum() and low[k].isascii()


def stands(low: str, start: int, end: int, kind: str) -> bool:
    """Whether a match is one: not within a word, a status with its number, a field not in other syntax."""
    first, last = low[start], low[end - 1]
    if kind == "placeholder":
        before, after = low[start - 1 : start], low[end : end + 1]
        if first in "$%" and (word_at(low, start - 1) or before == first or after and after in "({" or last not in "})%s" and (word_at(low, end) or after == "_")):
            return False
        if first == "_" and before.isalnum() or last == "_" and after.isalnum() or first == "{" and before and before in "{$#%" or last == "}" and after == "}" and low[start : start + 2] != "{{":
            return low[start : start + 2] == "{{"
        if first == "<" and low[start : start + 2] != "<%" and "</" in low[end:]:
            return False
        return not (first == "[" and after and after in "(:" and low[start : start + 2] != "[[")
    if word_at(low, start) and word_at(low, start - 1) or word_at(low, end - 1) and word_at(low, end):
        return False
    return kind != "status" or bool(_STATUS.search(low[max(0, start - 6) : start]))


class Part:
    """What the automaton matches in a text, and how many letters there are to match."""

    def __init__(self, line: str):
        low = line.lower()
        if len(low) != len(line):  # a few letters grow in lower case
            line = low
        self.line, self.quiet = line, False
        self.spans: dict[str, list[tuple[int, int]]] = {}
        for last, (n, kind) in automaton().iter(low):
            start, end = last + 1 - n, last + 1
            if stands(low, start, end, kind):
                self.spans.setdefault("error" if kind == "status" else kind, []).append((start, end))
        self.total = self.covered = 0
        if not self.spans:
            self.total = sum(map(str.isalpha, line))

    def share(self, kind: str) -> float:
        line, own = self.line, self.spans[kind]
        letter = [c.isalpha() for c in line]
        if kind != "placeholder":
            for m in TAG.finditer(line):
                letter[m.start() : m.end()] = [False] * (m.end() - m.start())
            if not any(letter):  # all of it in a tag or comment, such as a prompt
                letter = [c.isalpha() for c in line]
        hit = [False] * len(line)
        for a, b in own:
            hit[a:b] = [True] * (b - a)
        self.total = sum(letter)
        self.covered = sum(x and y for x, y in zip(hit, letter))
        return self.covered / self.total if self.total else float(any(hit))

    def kind(self, commit: bool) -> str | None:
        """The kind that covers enough of the part, or None."""
        for kind in self.spans:
            if kind == "placeholder":
                if self.unfilled():
                    return kind
            elif self.share(kind) >= COVERAGE[kind][not commit] and (kind not in ("latin", "keys") or len(self.spans[kind]) >= 2):
                return kind
        return None

    def unfilled(self) -> bool:
        quoted = [m.span() for m in QUOTED.finditer(self.line)]
        own = [(a, b) for a, b in self.spans["placeholder"] if not any(x < a and b < y for x, y in quoted)]
        if not own:
            return False
        last = max(b for _, b in own)
        self.spans["placeholder"] = own + [m.span() for m in UNFILLED.finditer(self.line)]
        share = self.share("placeholder")
        rest = UNFILLED.sub("", self.line[last:])
        return share >= COVERAGE["placeholder"][0] or share >= AT_END and not any(map(str.isalnum, rest))


def residue(text: str | None) -> str | None:
    """placeholder, prompt, filler, error or scripts if such text stands in the place of content; else None."""
    if not text:
        return None
    cut = _DIFF.search(text)
    head, diff = (text[: cut.start()], text[cut.start() :]) if cut else (text, "")
    commit = bool(cut)
    lines: list[str] = []
    authors: list[str] = []
    subject = True  # whether it is still to come
    for raw in head.removeprefix("\ufeff").splitlines():
        line = raw.strip()
        if line.startswith("Subject:"):
            line = line[8:].strip().removeprefix("[PATCH]").strip()
            subject = True
        if MARKS.fullmatch(line) or subject and RULES.fullmatch(line):
            return "filler"
        if not line or _HEADER.fullmatch(line):
            commit |= bool(line) and line[0].isalpha()
            continue
        if m := _AUTHOR.fullmatch(line):
            commit = True
            authors.append(m["a"] or m["b"] or m["c"] or "")
            continue
        subject = False
        if FIELD.fullmatch(line):
            return "placeholder"
        if REPEATED.fullmatch(line):
            return "filler"
        lines.append(line)
    for author in authors:
        own = Part(author)
        if "placeholder" in own.spans or FIELD.search(author) or "person" in own.spans and own.share("person") >= COVERAGE["person"][0]:
            return "placeholder"
    parts = [Part(line) for line in lines]
    for part in parts:
        if kind := part.kind(commit):
            return NAMED.get(kind, kind)
    if not commit and (kind := overall(parts)):
        return kind
    if diff:
        for m in _LOOSE.finditer(diff):
            line = m[0].strip()
            if FIELD.fullmatch(line):
                return "placeholder"
            if kind := Part(line).kind(False):
                return NAMED.get(kind, kind)
    return None


def overall(parts: list[Part]) -> str | None:
    """The kind of error, script or filler text that covers half of all the letters of a text."""
    total = sum(p.total for p in parts)
    for kind in ("error", "scripts", "filler"):
        hits = [p for p in parts if kind in p.spans]
        if hits and sum(p.share(kind) * p.total for p in hits) >= 0.5 * max(total, 1):
            return kind
    return None


def find_residue(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key and kind of the rows whose text is residue; null, empty and blank texts never are.

    Whole texts are read; one row comes out for each row found, so repeated texts give repeated rows.
    A narrow operation; other columns of df are ignored.
    """
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, kind string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = pa.array([residue(s) for s in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), kinds], [key, "kind"]).filter(kinds.is_valid())

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


def without_residue(df: DataFrame, text: str = "text") -> DataFrame:
    """df without the rows found: one pass over whole rows, no join."""
    at = df.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([residue(s) is None for s in b.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)
