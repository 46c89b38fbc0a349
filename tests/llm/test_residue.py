"""Residue by wording that was written down before the phrase tables were, from no table: what is found and what isn't."""

import pytest

from mentia.llm import residue as R

HELD_OUT = {
    "en": """This site requires JavaScript to run correctly.
JavaScript is disabled in your browser. Please enable it and refresh the page.
You must turn on JavaScript to continue.
It looks like you are using an outdated browser. Please upgrade to a newer version.
We're sorry, but this app doesn't work properly without JavaScript enabled.
Are you a human? Please complete the security check to continue.
We have detected unusual traffic from your computer network.
404 Not Found
The requested URL was not found on this server.
This page doesn't exist or has been deleted.
The content you requested is no longer available.
500 Internal Server Error
503 Service Unavailable
We are currently down for scheduled maintenance. Please check back soon.
An unexpected error occurred. Please try again later.
The server encountered a temporary error and could not complete your request.
Error establishing a database connection
You don't have permission to access this page.
Your login session has timed out. Please log in again.
This article has been removed.
Insert your text here
Add your content here
This is a placeholder for the body text.
Sample heading text
Lorem ipsum dolor sit amet, consectetur adipiscing elit
Page under construction
Too many requests, please slow down
undefined is not a function
Uncaught ReferenceError: title is not defined
NullPointerException at com.site.Render.main(Render.java:42)""",
    "vi": """Trang web này cần JavaScript để hoạt động.
Bạn cần bật JavaScript để tiếp tục.
JavaScript đã bị tắt trong trình duyệt của bạn.
Trình duyệt của bạn đã lỗi thời, vui lòng nâng cấp.
Vui lòng xác minh bạn là con người.
Trang bạn đang tìm không tồn tại.
Không tìm thấy trang
Liên kết này đã hết hạn.
Nội dung này hiện không có sẵn.
Bài viết này đã bị xóa.
Đã có lỗi xảy ra, vui lòng thử lại sau.
Lỗi máy chủ nội bộ
Hệ thống đang bảo trì
Máy chủ đang quá tải, vui lòng thử lại sau ít phút.
Bạn không có quyền xem trang này.
Truy cập bị từ chối
Phiên đăng nhập của bạn đã hết hạn.
Nội dung đang được cập nhật
Nhập văn bản vào đây
Đây là văn bản mẫu
Trang đang được xây dựng
Không thể kết nối đến máy chủ""",
    "es": """Este sitio requiere JavaScript para funcionar.
Debe habilitar JavaScript en su navegador para continuar.
JavaScript está desactivado en su navegador.
Su navegador está desactualizado. Actualice a una versión más reciente.
Verifique que usted es humano.
La página solicitada no existe.
No se ha encontrado la página
El enlace ha caducado.
Este contenido ya no está disponible.
El artículo ha sido eliminado.
Se ha producido un error inesperado. Inténtelo de nuevo más tarde.
Error interno del servidor
Sitio en mantenimiento, vuelva pronto
El servidor no responde
No tiene permiso para acceder a esta página.
Acceso prohibido
Su sesión ha expirado, inicie sesión de nuevo.
Próximamente
Inserte su texto aquí
Este es un texto de relleno
Página en construcción
Demasiadas solicitudes, espere un momento
No se pudo conectar con la base de datos""",
    "de": """Diese Seite benötigt JavaScript.
Bitte aktivieren Sie JavaScript in Ihrem Browser, um fortzufahren.
JavaScript ist in Ihrem Browser deaktiviert.
Ihr Browser ist veraltet. Bitte aktualisieren Sie ihn.
Bitte bestätigen Sie, dass Sie ein Mensch sind.
Die angeforderte Seite existiert nicht.
Die Seite konnte nicht gefunden werden
Der Link ist abgelaufen.
Dieser Inhalt ist nicht mehr verfügbar.
Dieser Artikel wurde gelöscht.
Es ist ein unerwarteter Fehler aufgetreten. Bitte versuchen Sie es später erneut.
Interner Serverfehler
Die Website wird derzeit gewartet.
Der Server antwortet nicht
Sie haben keine Berechtigung, diese Seite anzusehen.
Zugriff verboten
Sie wurden abgemeldet, bitte melden Sie sich erneut an.
Inhalt folgt
Hier Text eingeben
Dies ist ein Platzhaltertext
Seite im Aufbau
Zu viele Anfragen, bitte warten Sie
Keine Verbindung zur Datenbank möglich""",
    "fr": """Ce site nécessite JavaScript pour fonctionner.
Vous devez activer JavaScript dans votre navigateur pour continuer.
JavaScript est désactivé dans votre navigateur.
Votre navigateur est obsolète. Veuillez le mettre à jour.
Veuillez confirmer que vous êtes humain.
La page demandée n'existe pas.
Page non trouvée
Le lien a expiré.
Ce contenu n'est plus disponible.
Cet article a été supprimé.
Une erreur inattendue s'est produite. Veuillez réessayer plus tard.
Erreur interne du serveur
Site en maintenance, revenez bientôt
Le serveur ne répond pas
Vous n'avez pas l'autorisation d'accéder à cette page.
Accès interdit
Votre session est expirée, veuillez vous reconnecter.
Contenu à venir
Saisissez votre texte ici
Ceci est un texte de remplissage
Page en construction
Trop de requêtes, veuillez patienter
Impossible de se connecter à la base de données""",
}

REAL = """Acme asked its customers to enable JavaScript before they pay 135 euros for the ticket.
The ministry said "page not found" stood on its site for two hours on Monday.
Visitors saw « accès refusé » until noon, the operator in Lyon wrote.
The server in Rome was replaced after an error in the billing of 300 accounts, the founder said.
A spokesman said the service was unavailable in Hanoi for a day and that 40 shops lost their orders.
Người dùng ở Hà Nội thấy dòng "không tìm thấy trang" suốt 12 phút hôm thứ Năm.
Công ty cho biết hệ thống của 12 cửa hàng bị lỗi sau khi nhân viên cập nhật giá mới hôm thứ Hai.
La portavoz explicó que el servidor de la tienda falló el lunes y que 20 pedidos se perdieron en Sevilla.
Der Sprecher sagte, der Server in Bonn sei am Montag ausgefallen und 30 Bestellungen seien verloren.
La porte-parole explique que le serveur du magasin est tombé en panne lundi et que 20 commandes ont été perdues.
Billing errors! Nabetal Pota Kit
The newspaper removed the article about the mayor after a judge asked for it on Friday.
The session in parliament ended late and the vote on the link road was moved to May.
Er bestätigte, dass kein Mensch verletzt wurde und dass der Roboter im Werk weiter läuft.
The template that the shop sends to its 400 customers was changed in April by two former engineers.
By staying on this page you agree to our cookie policy.
Material on this site may not be republished without written permission.
Log in to reply
Follow us on every channel
The software update for the browser was praised by reviewers, while the price of the new phone drew complaints.""".split("\n")


@pytest.mark.parametrize("lang", sorted(HELD_OUT))
def test_unseen_wording_is_found(lang):
    lines = HELD_OUT[lang].split("\n")
    missed = [x for x in lines if not R.is_residue(x)]
    assert len(lines) >= 20 and len(missed) <= 0.1 * len(lines), missed


@pytest.mark.parametrize("line", REAL)
def test_articles_that_tell_of_it_are_kept(line):
    assert not R.is_residue(line)
