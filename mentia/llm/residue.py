"""Problem 2: template residue, filler, error pages and script notices in place of content.

A message of this kind names a thing and what is wrong with it: scripts that are off, a page that can't be
found. Both come in many wordings, so one multi-pattern automaton over the parts of all families, in five
languages, finds the lines in which the parts of one family meet; a few fixed phrases (HTTP reasons, traces,
filler) are families of one part, placeholders are found by the syntax of common template languages. Of
such a line each sentence is matched as far as its words are those of messages: COVERAGE of its words must be
among the parts and the message words below, so that a sentence of an article that speaks of a server, with
names, places and sums, isn't one. A line is residue where matched sentences are LINE_COVERAGE of its letters; a
record is excluded where residue lines stand in the place of its article or of a part of it. Text in quotation
marks doesn't count, and notices that a site repeats around its articles are not looked at: they are unimportant
nodes of the site's style tree. A placeholder outside quotation marks is a missing part of the article by itself.
"""

from __future__ import annotations

import re
from functools import lru_cache

# The families: what is named | what is said of it. A part ending in * goes on in any way, others are whole words.
# Wording of browsers, servers, content systems and page templates as they are commonly met in the five languages.
FAMILIES = {
    "scripts": (
        "javascript, java script, script, scripts, mã lệnh, mã script, skript*",
        "enabl*, turn on, turned on, turning it on, turn it on, switch on, switched on, activat*, requir*, need*, disabled, turned off, blocked, without, support*, allow, bật, kích hoạt, cần, yêu cầu, bị tắt, hỗ trợ, chặn, activar, activa*, active, habilit*, requiere, necesita, desactivad*, deshabilitad*, admite, permita, bloque*, activer, activez, nécessit*, désactiv*, autoris*, requis, aktivier*, einschalt*, eingeschaltet, deaktiviert, benötigt, erforderlich, ausgeschaltet, erlauben, führt",
    ),
    "browser": (
        "browser, browsers, trình duyệt, navegador, navigateur",
        "support*, not supported, unsupported, outdated, out of date, upgrade, update it, checking, too old, old version, không hỗ trợ, lỗi thời, nâng cấp, hãy cập nhật, kiểm tra, quá cũ, desactualizado, actualícelo, actualice, comprobando, no es compatible, obsoleto, antiguo, obsolète, vérification, vérifions, mettre à jour, pas pris en charge, pas compatible, veraltet, aktualisieren, geprüft, überprüft, nicht unterstützt, wird nicht",
    ),
    "human": (
        "robot, robots, human, humans, captcha, bot, người máy, con người, rô bốt, humano, humana, humain, mensch, roboter",
        "verify, verifying, confirm, confirmer, prove, are you, not a, check, xác nhận, xác minh, không phải, chứng minh, verifi*, no es un, no soy, demuestre, vérifi*, n'êtes pas, ne suis pas, prouvez, bestätigen, kein, keine, nachweisen",
    ),
    "traffic": (
        "requests, traffic, attempts, yêu cầu, lượt truy cập, solicitudes, peticiones, intentos, requêtes, demandes, tentatives, anfragen, zugriffe, versuche",
        "too many, unusual, suspicious, slow down, quá nhiều, bất thường, demasiad*, inusual, trop de, inhabituel*, zu viele, ungewöhnlich*",
    ),
    "page": (
        "page, pages, url, link, address, article, post, content, file, video, item, resource, trang, liên kết, đường dẫn, bài viết, nội dung, video này, tài nguyên, página, enlace, artículo, contenido, vídeo, archivo, recurso, lien, contenu, vidéo, fichier, ressource, adresse, seite, artikel, beitrag, inhalt, datei, dokument",
        "not found, can't find, cannot find, couldn't find, could not find, cannot be found, could not be found, can't be found, does not exist, doesn't exist, never existed, no longer, moved, been removed, been deleted, was removed, was deleted, expired, is gone, unavailable, not available, isn't available, is private, không tìm thấy, không tồn tại, bị gỡ, bị xóa, bị xoá, đã gỡ, hết hạn, không khả dụng, không có sẵn, không còn, riêng tư, no encontrad*, no se encontró, no se ha encontrado, no se encuentra, no podemos encontrar, no existe, no está disponible, no disponible, ya no, eliminad*, retirad*, caducad*, expirad*, introuvable*, non trouvé*, pas trouvé*, n'existe*, supprimé*, retiré*, a expiré, est expiré, indisponible*, pas disponible, plus disponible, n'est plus, nicht gefunden, existiert nicht, nicht existiert, nicht mehr, nicht verfügbar, gelöscht, entfernt, abgelaufen",
    ),
    "access": (
        "access, permission, permissions, authori*, quyền, truy cập, acceso, permiso, autorización, accès, autorisation, droits, zugriff, zugang, berechtigung*, rechte",
        "denied, do not have, don't have, forbidden, blocked, restricted, không có quyền, bị từ chối, bị chặn, bị cấm, denegado, no tiene*, prohibido, restringido, refusé, interdit, n'avez pas, bloqué, restreint, verweigert, keine, verboten, gesperrt, nicht berechtigt",
    ),
    "session": (
        "session, login, log in, sign in, phiên, đăng nhập, sesión, connexion, sitzung, anmeldung, abgemeldet, melden sie sich",
        "expired, timed out, has ended, again, hết hạn, lại, ha caducado, ha expirado, caducada, de nuevo, expiré*, reconnect*, abgelaufen, erneut",
    ),
    "server": (
        "server, servers, service, database, gateway, upstream, site, website, web site, system, connection, network, host, máy chủ, hệ thống, dịch vụ, kết nối, trang web, cơ sở dữ liệu, servidor, servicio, sitio, conexión, sistema, base de datos, serveur, site, connexion, système, base de données, server, serverfehler, dienst, verbindung, datenbank, webseite, webserver",
        "unavailable, timeout, time-out, timed out, did not respond, not responding, did not answer, no response, refused, failed, internal, could not complete, couldn't complete, temporary error, maintenance, overloaded, is down, are down, bảo trì, không phản hồi, quá tải, gián đoạn, không thể, lỗi, từ chối, interno, no responde, tardó demasiado, no disponible, mantenimiento, sobrecargad*, no se pudo, rechaz*, fallo de, ne répond pas, indisponible*, en maintenance, surchargé*, interne, impossible, a refusé, délai, zeitüberschreitung, antwortet nicht, wartung*, gewartet, überlastet, nicht erreichbar, interner, keine, fehlgeschlagen",
    ),
    "error": (
        "error, errors, problem, lỗi, sự cố, fallo, problema, erreur, problème, fehler",
        "occurred, has occurred, unexpected, encountered, establishing, try again, loading, please, xảy ra, không xác định, thử lại, ha ocurrido, ocurrió, se ha producido, se produjo, inesperad*, inténtelo, est survenue, s'est produite, inattendue, réessay*, aufgetreten, ist passiert, unerwartet*, versuchen sie",
    ),
    "code": ("error, http, code, status, lỗi, mã lỗi, fehler, erreur, código, statut", "4##, 5##"),
    "fill": (
        "text, copy, paragraph, headline, heading, title, content, post, teaser, caption, image, description, văn bản, tiêu đề, bài viết, nội dung, đoạn, hình ảnh, texto, titular, título, contenido, artículo, entradilla, imagen, texte, titre, contenu, article, légende, image, überschrift, titel, inhalt, absatz, bild, beitrag",
        "dummy, sample, example, placeholder*, filler, goes here, insert, your text here, text here, add your, enter your, type your, write your, to follow, is a test, mẫu, ở đây, vào đây, nhập, giả, đang được cập nhật, chờ cập nhật, de ejemplo, de prueba, de muestra, de relleno, aquí, inserte, introduzca, escriba, próximamente, faux, d'exemple, de remplissage, ici, insér*, saisi*, à compléter, à venir, blind, beispiel*, muster*, hier, einfügen, eingeben, ergänzen, folgt",
    ),
    "ignore": (
        "test, test page, sample, draft, page de test, article de test, testseite, prueba, esta página, bài kiểm tra, trang thử, bài thử",
        "ignore*, do not publish, delete it, delete this, bỏ qua, xóa, xoá, no hagan caso, ignoren, ignorer, l'ignorer, ignorieren, nicht veröffentlichen",
    ),
    "building": (
        "page, site, website, section, content, trang, chuyên mục, nội dung, página, sitio, sección, contenido, rubrique, page, contenu, seite, website, bereich, inhalt",
        "under construction, coming soon, to follow, being updated, đang được xây dựng, đang xây dựng, đang được cập nhật, đang cập nhật, sắp ra mắt, en construcción, próximamente, en construction, à venir, bientôt, im aufbau, in kürze, folgt",
    ),
}
# Families of one part. One of a single short word must be a third of its sentence.
PHRASES = """
bad gateway, gateway timeout, internal server error, service unavailable, not found, forbidden, bad request, unauthorized, too many requests, request timeout
something went wrong, something broke, an error occurred, went wrong, sorry for the inconvenience, traceback (most recent call last), fatal error, uncaught, stack trace
segmentation fault, unhandled exception, nullpointerexception, typeerror, referenceerror, syntaxerror, keyerror, valueerror, sqlstate, core dumped, is not a function, is not defined
[object object], undefined, null, nan, none none, asdf, asdfg, qwer, qwerty, xxxx, xxxxx, foo bar, blah blah, test test, todo, tbd, tba, draft, untitled, no title, blank page
your text here, text goes here, headline goes here, lorem ipsum, dummy text, dummy copy, sample post, sample page, placeholder text, placeholder paragraph
scheduled maintenance, coming soon, under construction, loading..., loading…, please wait, redirecting, down for maintenance, be right back, check back soon
đã xảy ra lỗi, có lỗi xảy ra, văn bản mẫu, bản nháp, chưa có tiêu đề, đang tải, vui lòng chờ, sắp ra mắt, không tìm thấy trang
algo salió mal, algo ha fallado, en construcción, borrador, sin título, cargando, espere un momento, próximamente, prueba prueba, acceso denegado
une erreur est survenue, un problème est survenu, en construction, brouillon, sans titre, chargement en cours, veuillez patienter, à venir, faux texte, texte à compléter
wartungsarbeiten, schiefgelaufen, schiefgegangen, blindtext, platzhaltertext, beispieltext, mustertext, in kürze, im aufbau, entwurf, ohne titel, wird geladen, bitte warten, serverfehler
"""
# Words that messages are made of beside those parts: function words and what readers are asked to do.
WORDS = """
a about access again allow also an and any app are article as at available back be because been before being below body browser but by cache can check click close code come complete completing computer contact content continue
cookies correctly could create current currently date delete detected device did disabled display do does doesn't don't due edge enable encountered error exist expect experience extension few final find first for from function get go gone
has have headline help here home how human i id if image in into is it it's its item javascript just later layout let line like link load loading location log long longer look looks made make maintenance may maybe max message minute minutes
moment more most moved must need needs network never new newer next no node nothing now number of off old on once one only open opening oops or order other our out page paragraph perform please post private proceed
product properly provide proxy public published ray ref reference refresh region reload removed replace replaced request requested requires resource retry return run sample scheduled scripts search second seconds security see seem seems server
session several should sign site so some something soon sorry start still stopped such support system takes task teaser temporarily temporary text than that the their then there these they this time title to today too tried try trying turn turning two
type unexpected until update updated up upgrade url us use user using version verify very view visit wait was we we're web were what when which while who will with within without words working write writing wrong you you're your
article's first-name intro lists main null nan none undefined render
# vi
bài báo bạn bị bật bởi các cách cần cập cho chúng chưa chờ con có cơ của cũ dữ dung duyệt dùng dịch đã đang đăng đây đến để điều định đoạn đó đổi đợi được gặp gỡ giây giờ hãy hạn hết hiện hiển hiểu hoặc hoạt hỗ hợp kết khả khi không khu kiểm kiện lại lần làm lệnh lệ liên liệu lên lỗi lòng lúc lượt mã máy mẫu mất mở mới một mục này nào nâng năng nạp ngoài ngừng ngữ
người nhật nhập nhà nhé nhiều những nhưng nối nội nữa ở phải phát phép phiên phiên phút phục quay quá quản quyền ra rất rồi sau sẵn sẽ số sử sự sửa tác tải tại tạm tập tên thành thay thấy thể theo thêm thiết thông thời thử thực tiếp tiếng tiêu tìm tin tồn tôi tới trang tránh trên tra trì trình trong trống trợ trước trở truy từ tự tắt ứng và vào văn vẫn về vì viết việc viên vui vụ với vực xác xảy xem xin xóa xoá yêu nhận phải robot
# es
a abajo abrir acceder acceso actual ahora al algo algunos antes aquí archivo así atrás ayuda bien caso cargar casa clic código como compatible compruebe con conectar conexión contenido continuar cookies corregir correctamente cuando de debe del desde después dirección disponible dispositivo donde durante e el ella en entrar error es esa ese espere esta está este esto estos favor final funcionar funcione ha
hacer hagan haga han hasta hay humano inicie inicio intente inténtelo la las le lo los luego maqueta más mantenimiento más me mensaje mientras minutos momento muy navegador necesita ninguna no nos nueva nuevo nuestra o otra página para parece pero poco podemos por pronto pronta publicar pudo puede que quitar recargue reciente red región reintente se sección segundos ser servidor si sido sin sistema
sitio sobre solicitada solicitado su sus sustituir también tarde temporalmente texto tiempo tiene todavía un una unos usar usted utilice ver verificar versión versión vez visualizar volver vuelva y ya
# fr
à accéder actualiser actualisez adresse afficher ai aide ainsi après article au aucun aux avant avec avez base bientôt bien bloque blocs c'est car ce ceci cela cette ces cet cliquez code comme connecter connexion contenu continuer correctement d'abord d'accéder d'ouvrir dans de demandée demandé déjà depuis des désolé deux disponible donc du elle en encore erreur est et être êtes faire fonctionner fonctionne humain ici il impossible inattendue instant
interne internet jour l'accès l'adresse l'article l'équipe la lien laquelle le les leur lire lui ma mais maquette maintenance mais merci mettre minutes moment mois navigateur ne nos notre nous nouveau nouvelle n'est on ou oups page par paramètres pas patienter peu plus plusieurs pour pouvez produite puis quelques que qui rafraîchir rechargez recharger région réessayer réessayez rester revenez reconnecter rubrique s'est sa sans scripts section serveur ses session si
site son sont sous sur tard temps texte toujours tout trop trouver un une utiliser utilisez veuillez vérifier version vérifiez visiter voir vos votre vous y plutôt cours
# de
ab aber alle als am an anmelden angefordert angeforderte anzeigen anzusehen auch auf beim bevor aufgerufen aufrufen aus bald bei bis bitte da damit danach dann das dass dem den der derzeit des die dies diese diesem diesen dieser dieses dort du ein eine einem einen einer eines einmal erneut erst es etwas fehler fortfahren fortzufahren fort für gefunden gerade geöffnet gleich haben hat hier
ich ihm ihn ihr ihre ihrem ihren ihrer im immer in ist ja jetzt kann kennung kein keine können konnte layout laden leider lassen mal man mehr mensch minuten mit möglich moment nach neu neue neuere nicht nichts noch nun nur nutzen ob oder öffnen oops ort prüfen region roboter schritt sehen sein seite seiten sekunden selbst server sich sicherheit sie sind so sobald sollte sowie später suche
text über überprüfen um und uns unser unsere unter version versuchen verwenden vom von vor vorgang vorübergehend wann war warten was weiter wenn werden wieder wir wird wurde wurden zeigen zu zum zur zurück zurzeit verbindung
"""
# Words of the Latin filler text.
FILLER = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et
dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat
duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat
non proident sunt culpa qui officia deserunt mollit anim id est laborum vitae mauris praesent morbi tincidunt""".split()
# Placeholders of common template languages and mail systems.
PLACEHOLDER = re.compile(
    r"\$?\{\{[^{}]+\}\}|\{%[^%]+%\}|<%=?[^%]+%>|%%\w+%%|@@\w+@@|[$#]\{[^{}]+\}"
    r"|\[\[?[A-Z][A-Z_]{2,}\]?\]|<<[\w.]+>>|\*\|\w+\|\*|__[A-Z]\w+__|\$[a-z]\w+\$?|\{[a-zA-Z][\w.]{2,}\}|\b[a-z]+(?:\.[a-z]+)+_\d+\b"
)
# Words by which a sentence tells of placeholders instead of having one left over.
TELLS = re.compile(r"\b(?:template|placeholder|plantilla|marcador|modèle|gabarit|vorlage|platzhalter|bản mẫu|khuôn mẫu)\b", re.I)
#: Share of a sentence's words that must be those of messages; the share of a line's letters in matched sentences.
COVERAGE, LINE_COVERAGE = 0.8, 0.5
#: A line is residue from this many placeholders.
LINE_PLACEHOLDERS = 2
#: A record goes where residue lines are this share of the characters that stand for its article.
RECORD_COVERAGE = 0.02
_WORD, _SENTENCE = re.compile(r"[^\W_]+(?:['’][^\W_]+)*"), re.compile(r"(?<=[.!?…;:])\s+|\s[-–—|·]\s")
_SPACES = re.compile(r"\s{2,}|[^\S ]")
_SPLIT = re.compile(r",\s+")


def _parts(text: str) -> list[str]:
    return [p.strip() for line in text.strip().splitlines() for p in _SPLIT.split(line) if p.strip()]


@lru_cache(maxsize=1)
def automaton():
    """Every part with its (family, side) marks, as bits: one for what is named, one for what is said of it."""
    import ahocorasick

    marks: dict[str, int] = {}
    for k, sides in enumerate(FAMILIES.values()):
        for side, text in enumerate(sides):
            for part in _parts(text):
                marks[part] = marks.get(part, 0) | 1 << 2 * k + side
    for part in _parts(PHRASES):
        marks[part] = marks.get(part, 0) | (WORD if " " not in part and len(part) < 9 else ALONE)
    found = ahocorasick.Automaton()
    for part, mark in marks.items():
        text = part.rstrip("*")
        found.add_word(text, (len(text), mark, part.endswith("*")))
    for word in FILLER:
        if len(word) >= 5:
            found.add_word(word, (len(word), FILL, False))
    found.make_automaton()
    return found


@lru_cache(maxsize=1)
def message_words() -> frozenset[str]:
    """All words of the parts, of one part's families and of WORDS."""
    out = {w for line in WORDS.splitlines() if not line.startswith("#") for w in line.split()}
    for text in (PHRASES, *(side for sides in FAMILIES.values() for side in sides)):
        out |= {w for part in _parts(text) for w in _WORD.findall(part.rstrip("*"))}
    return frozenset(out)


@lru_cache(maxsize=1)
def message_stems() -> tuple[str, ...]:
    return tuple(sorted({p.rstrip("*").split()[-1] for sides in FAMILIES.values() for side in sides for p in _parts(side) if p.endswith("*")}))


#: A message about a part beside the article says nothing of the article.
BESIDE = re.compile(r"\b(?:comment|comments|kommentare?|commentaires?|comentarios?|bình luận|newsletter|ads?|advert\w*|werbung|anzeigen|publicité|publicidad|quảng cáo|cookie policy)\b")
_FILLER = frozenset(FILLER)
ALONE, WORD, FILL = (1 << 2 * len(FAMILIES) + k for k in range(3))
_NAMED = sum(1 << 2 * k for k in range(len(FAMILIES)))


_MARKS = re.compile(r"[{\[<%@_$|]|\._\d|_\d")


def quoted(text: str, start: int, end: int, reach: int = 90) -> bool:
    """Whether [start, end) stands between quotation marks not far away, in the same paragraph."""
    left, right = text[max(0, start - reach) : start], text[end : end + reach]
    for a, b in (("\"", "\""), ("“", "”"), ("„", "“"), ("«", "»")):
        at = left.rfind(a)
        if at >= 0 and b in right and (a == b and left.count(a) % 2 == 1 or a != b and b not in left[at + 1 :]):
            return True
    return False


def _plain(text: str) -> str:
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.replace("’", "'")


_CODES = re.compile(r"\b([45])\d\d\b")


def spans(low: str) -> list[tuple[int, int, int]]:
    """(start, end, marks) of the parts in a lower-case text."""
    out, n = [], len(low)
    for last, (size, mark, open_end) in automaton().iter(low):
        start, end = last - size + 1, last + 1
        if (start == 0 or not (low[start - 1].isalnum() and low[start].isalnum())) and (open_end or end >= n or not (low[end].isalnum() and low[last].isalnum())):
            out.append((start, end, mark))
    return out


def complete(marks: int) -> bool:
    """Whether both sides of a family, or a family of one part, are among the marks."""
    return bool(marks & (ALONE | WORD)) or bool(marks & marks >> 1 & _NAMED)


def _marks(found: list[tuple[int, int, int]]) -> int:
    """The marks of parts, each side of a family by a place of its own."""
    got = 0
    for start, end, mark in found:
        if mark & mark >> 1 & _NAMED:
            # one part can't be both sides
            mark = mark & _NAMED if any(m & mark & ~_NAMED and (a >= end or b <= start) for a, b, m in found) else mark & ~_NAMED
        got |= mark
    return got


@lru_cache(maxsize=200_000)
def _is_message_word(word: str) -> bool:
    return word in message_words() or any(c.isdigit() for c in word) or word.startswith(message_stems()) or len(word) > 1 and word == word[0] * len(word)


def _sentence_share(low: str) -> float:
    """Share of a sentence's words that are those of messages; of traces, what looks like code counts."""
    words = _WORD.findall(low)
    if not words:
        return 0.0
    if re.search(r"error\b.*[:(]|exception|traceback|\w+\.\w+\(|/[\w.]+/|line \d+", low) and re.search(r"fatal|uncaught|traceback|exception|error:|is not defined|is not a function", low):
        return 1.0
    return sum(map(_is_message_word, words)) / len(words)


def matched(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences of a line that are messages, or filler."""
    low = _plain(text)
    found = spans(_CODES.sub(r"\1##", low))
    if not found:
        return []
    filler = [m.span() for m in _WORD.finditer(low) if m.group() in _FILLER] if sum(m == FILL for _, _, m in found) >= 2 else []
    if not complete(_marks(found)) and not filler:
        return []
    # what a template left open is judged by itself
    if "{" in low or "%" in low or _MARKS.search(low):
        low = PLACEHOLDER.sub(lambda m: " " * len(m.group()), text)
        low = _plain(low)
    out, at, latest = [], 0, False
    bounds = [*[(m.start(), m.end()) for m in _SENTENCE.finditer(text)], (len(text), len(text))]
    for stop, after in bounds:
        if BESIDE.search(low, at, stop):
            at, latest = after, False
            continue
        single = sum(bool(m & WORD) for a, b, m in found if at <= a and b <= stop)
        weak = single and 3 * single < len(_WORD.findall(low, at, stop))
        own = [(a, b, m & ~WORD if weak else m) for a, b, m in found if at <= a and b <= stop and not quoted(text, a, b)]
        share = _sentence_share(low[at:stop])
        # what follows a message and is made of its words belongs to it
        if share >= COVERAGE and complete(_marks(own)) or latest and share >= 0.8:
            out.append((at, stop))
            latest = True
        else:
            latest = False
        at = after
    if len(filler) >= 4 and len({low[a:b] for a, b in filler}) >= 4:
        out += filler
    return [s for s in out if not quoted(text, *s)]


def holders(text: str) -> list[tuple[int, int]]:
    """Spans of placeholders outside quotation marks."""
    return [m.span() for m in PLACEHOLDER.finditer(text) if not quoted(text, *m.span())] if _MARKS.search(text) else []


def coverage(text: str) -> tuple[float, int]:
    """(share of the letters and digits of a line inside matches, number of placeholders)."""
    left = holders(text)
    found = matched(text) + left
    if not found:
        return 0.0, 0
    return _share(text, found), len(left)


def _share(text: str, found: list[tuple[int, int]]) -> float:
    """Share of the letters and digits of a line inside spans."""
    marked = bytearray(len(text))
    for a, b in found:
        marked[a:b] = b"\1" * (b - a)
    total = hit = 0
    for i, c in enumerate(text):
        if c.isalnum():
            total += 1
            hit += marked[i]
    return hit / total if total else 0.0


@lru_cache(maxsize=50_000)
def is_residue(text: str) -> bool:
    """Whether a line is residue by its matched coverage. Lines repeat, and are asked for more than once."""
    share, left = coverage(_SPACES.sub(" ", text))
    return left >= LINE_PLACEHOLDERS or share >= LINE_COVERAGE


@lru_cache(maxsize=50_000)
def _is_message(text: str) -> bool:
    """``is_residue`` of a line without marks of placeholders."""
    text = _SPACES.sub(" ", text)
    found = matched(text)
    return bool(found) and _share(text, found) >= LINE_COVERAGE


def in_place_of_content(lines: list[str]) -> bool:
    """Whether residue stands in place of an article or of a part of it, given the article's lines.

    Lines are judged alone; placeholders are also looked for in the joined lines, as a quotation may go
    over a wrapped line: one that isn't quoted or told of stands for a part of the article, however long that is. The
    share of the characters that counts is RECORD_COVERAGE.
    """
    total = sum(map(len, lines))
    joined = " ".join(lines)
    judge = is_residue if _MARKS.search(joined) else _is_message
    bad = sum(len(text) for text in lines if judge(text) and not TELLS.search(text))
    if bad:
        return bad >= RECORD_COVERAGE * total
    return judge is is_residue and any(not TELLS.search(joined, max(0, a - 80), b + 80) for a, b in holders(joined))
