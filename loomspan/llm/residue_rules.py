"""What problem 1 trusts at sight: unfilled fields, filler, error and wall messages."""

from __future__ import annotations

import re

# The field syntaxes of common template languages.
FIELDS = re.compile(
    r"\{\{\{?\s*[\w.\- ]{1,40}\}\}\}?|\{%\s*[\w.\- ]{1,40}%\}|<%[=-]?\s*[\w.\- ]{1,40}%>|[$#]\{\s*[\w.\-]{1,40}\s*\}|\[\[{1,2}\s*[\w.\-]{1,40}\s*\]\]{1,2}|%%[\w.]{2,40}%%|__[A-Z][A-Z_]{1,40}__"
    r"|\*\|[A-Z_]{2,40}\|\*|\$[A-Z][A-Z_]{2,40}\$|@Model\.\w+|@\{[\w.]{1,40}\}|&lt;[\w.]{2,40}&gt;|&amp;lt;[\w.]{2,40}|\{[a-z]\w{2,30}(?:\.\w{2,30})?\}"
    r"|<(?:YOUR|IHR|DEIN|SU|TU|VOTRE|SEU|TWÓJ|ВАШ)\s[^<>\n]{2,20}>|\[(?:insert|insérer|inserte|insertar|insira|wstaw|вставьте|enter|your)\b[^\]\n]{2,40}\]"
    r"|\[[^\]\n]{2,40}\b(?:hier einfügen|einfügen|aquí|ici|aqui|tutaj|здесь|here)\b[^\]\n]{0,20}\]|\((?:[\w.]+ ){1,3}goes here\)|\bTODO:\s?[\w.]+|\[object Object\]"
)
_EMPTY = re.compile(r"^\W*(?:undefined|null|NaN)\W*$|(?:^|\b(?:Hello|Hi|Dear|About|in|Price:|to:|By|on|Order|by|more about)\s+)(?:undefined|NaN|null)(?=\s*(?:[!.,;:|(]|$|on\b|was\b))")
# Words that show a text writes about such things.
_ABOUT = re.compile(r"\b(?:templates?|scripts?|placeholders?|brackets?|variables?|syntax|vorlagen?|platzhalter|skripts?|plantillas?|marcador|modèles?|gabarits?|modelos?|szablon\w*|шаблон\w*|скрипт\w*)\b[^.]{0,60}", re.I)

# The vocabulary of the customary Latin filler.
_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi "
    "aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
_SAMPLE = re.compile(
    r"\b(?:text|title|content|headline|caption|name|image) goes here|your (?:text|title|content|headline) here|this is your first post|welcome to your new site|just another (?:site|blog)|^\W*(?:coming soon|under construction|próximamente|bientôt disponible|demnächst|em breve|wkrótce|скоро)\W*$|sample (?:paragraph|text|content)\b.*(?:replace|own)|replace (?:it|this)(?: text)? with your own|add a short description|enter (?:sub)?title|(?:click|tap) (?:here )?to (?:edit|add)|placeholder text"
    r"|blindtext|beispieltext|platzhaltertext|hier steht später|ihr text hier|texto de (?:ejemplo|relleno|muestra|exemplo)|cámbielo por el suyo|su texto aquí|texte d[’']exemple|texte à remplacer|votre texte ici|seu texto aqui|tekst przykładowy|przykładowy tekst|twój tekst|пример текста|ваш текст|замените",
    re.I,
)
_REPEAT = re.compile(r"^(\w+(?:\W+\w+){0,2})(?:\W+\1){2,}\W*(?:\w+\W*)?$", re.I)

# Messages of servers, script notices, robot checks and sign-in demands, by language.
MESSAGES = re.compile(
    # errors
    r"page (?:not found|gone|introuvable|has moved|no longer)|\b(?:40[0-9]|41[0-9]|429|50[0-9])\b.{0,4}(?:[–:-]|forbidden|not found|service|internal|bad|gateway|too many|gone|unauthor|page|seite|página|erro|błąd|страниц)"
    r"|\b(?:error|erreur|fehler|http|błąd|ошибка)\s?(?:code\s)?#?\d{3}\b|(?:internal|interne|interno|interner)\s?(?:server|serverfehler|du serveur|del servidor|do servidor)|server\s?error|service unavailable|bad gateway|error interno|erreur interne|interner serverfehler"
    r"|request(?:ed)? (?:timed out|url was not found)|timed out|did not answer in time|fatal error|uncaught exception|traceback\b.*\bin\b|establishing a database|something went wrong|oops!|oups,|schiefgegangen|algo (?:salió|ha ido) mal|quelque chose s[’']est mal|coś poszło|что-то пошло"
    r"|can[’']t find the page|page you asked for|moved or never existed|no longer available|taken down by its owner|existe pas|n[’']existe plus|ya no existe|no existe|página no encontrada|page introuvable|seite nicht gefunden|gibt es leider nicht mehr|não (?:foi )?encontrad|nie znaleziono|nie istnieje|не найдена|больше не существует"
    r"|(?:access|accès|acceso|zugriff|acesso|dostęp|доступ)\b.{0,24}\b(?:denied|refusé|denegado|verweigert|negado|zabroniony|запрещ\w+)|forbidden|fehlernummer|^référence [0-9a-f]{6,}|^referencia [0-9a-f]{6,}|^reference no|^rays? (?:id:? )?[0-9a-f]{6,}|^id [0-9a-f]{8,}"
    # scripts
    r"|(?:enable|activate|turn on|switch on|allow|switched on|activez|activer|aktivieren|active|activar|habilite|ative|włącz|включите).{0,40}(?:javascript|scripts?|skripte|cookies and)|(?:javascript|scripts?|skripte|skrypt\w*|скрипт\w*)\b.{0,50}(?:disabled|deaktiviert|désactivé|desactivad|must be allowed|switched on|are off|cannot be shown|required|turned off|nicht angezeigt|wyłączon|отключ)"
    r"|(?:support|unterstützt kein|exécute pas|admite|suporta|obsługuje|поддерживает).{0,14}(?:javascript|scripts?)|(?:ohne|sans|sin|sem|bez|без) (?:javascript|skripte|scripts|skryptów|скриптов)|if nothing happens, allow scripts"
    # robot checks
    r"|captcha|turnstile|are(?:n[’']t| not) a robot|you[’']re not a robot|you are (?:a )?(?:human|person)|checking (?:your browser|if the connection)|just a moment|attention required|stopped from opening|unusual traffic|automated tools|^one more step|press and hold|challenge\.js|verify you|takes a few seconds"
    # sign-in
    r"|(?:log|sign) in (?:to (?:continue|read)|with your)|must be (?:logged|signed) in|members only|lost your password|connectez-vous pour|pas encore de compte|melden sie sich an|noch kein konto|inicie sesión para|aún no tiene cuenta|faça login|inicie sessão|zaloguj się,? aby|войдите, чтобы",
    re.I,
)
_BOUND = re.compile(r"(?<=[.!?…])[\"”»“’)]*\s+")
_WORD = re.compile(r"[^\W\d_]+")


_FIELD_HINT = re.compile(r"[{%_$<@\[&]|goes here|TODO|undefined|null|NaN|\*\|")
# Stems of which Latin filler always holds some.
_LATIN_STEMS = ("lorem", "ipsum", "dolor", "amet", "consect", "adipisc", "eiusmod", "nostrud", "ullamco", "labor", "aliqu", "fugiat", "pariatur", "veniam", "volupt")
# Parts of words of which sample wording always holds some.
_SAMPLE_HINTS = (
    "goes here", "text here", "title here", "content here", "headline here", "sample ", "replace ", "short description", "enter ", "to edit", "to add", "placeholder", "first post", "new site", "just another", "coming soon", "under construction",
    "blindtext", "beispieltext", "platzhalter", "hier steht", "text hier", "texto de", "cámbielo", "su texto", "próximamente", "texte d", "à remplacer", "votre texte", "bientôt", "demnächst", "seu texto", "em breve", "przykład", "twój tekst", "wkrótce", "пример", "ваш текст", "замените", "скоро",
)
#: A page with this many characters of sentences outside its messages has content.
ARTICLE_CHARS = 200
#: No message line is longer.
MESSAGE_CHARS = 240


def field_in(line: str) -> bool:
    """Does ``line`` hold an unfilled field in a place meant for content?"""
    if _FIELD_HINT.search(line) is None or (FIELDS.search(line) is None and _EMPTY.search(line) is None):
        return False
    for s in _BOUND.split(line):
        m = FIELDS.search(s) or _EMPTY.search(s)
        if m and not (_ABOUT.search(FIELDS.sub(" ", s)) and len(_WORD.findall(s)) >= 5):
            return True
    return False


def filler_in(line: str, latin: bool = True, sample: bool = True) -> bool:
    """Is ``line`` filler or sample wording? A sentence that quotes the words is not.

    ``latin`` and ``sample``: whether its text holds any word of these kinds.
    """
    if _REPEAT.match(line):
        return True
    if latin:
        words = _WORD.findall(line.lower())
        if len(words) >= 4 and sum(w in _LATIN for w in words) >= 0.7 * len(words):
            return True
    if len(line) > 140 or not sample:
        return False
    m = _SAMPLE.search(line)
    return bool(m) and not re.search(r"[“\"„«]", line[: m.start() + 1])


def judge(text: str) -> tuple[bool, bool]:
    """(text holds residue in a place of content, whole text is a message or filler).

    A message counts only where it stands instead of content: sentences
    outside the messages (long lines, or lines of several sentences) must
    not add up to an article.
    """
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    hints = _FIELD_HINT.search(text) is not None
    low = text.lower()
    latin, sample = any(s in low for s in _LATIN_STEMS), any(s in low for s in _SAMPLE_HINTS)
    residue, rest, mass = False, [], 0
    for line in lines:
        if (hints and field_in(line)) or filler_in(line, latin, sample):
            residue = True
        elif len(line) > MESSAGE_CHARS:
            mass += len(line)
        else:
            rest.append(line)
    if mass >= ARTICLE_CHARS:  # an article, whatever its short lines say
        return residue, False
    message = False
    for line in rest:
        parts = _BOUND.split(line)
        hit = [MESSAGES.search(s) is not None for s in parts]
        if any(hit):
            message = True
            mass += sum(len(s) for s, h in zip(parts, hit) if not h and len(s) >= 60)
        elif len(line) >= 100 or len(parts) >= 2:
            mass += len(line)
    return residue, (message or residue) and mass < ARTICLE_CHARS
