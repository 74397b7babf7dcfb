"""Labelled exemplars of residue in public, general wording, none of it taken from a corpus.

They are what common web servers, proxies, browsers, frameworks, content systems and document
templates write. ``(a|b)`` stands for alternatives, which are multiplied out.
"""

from __future__ import annotations

import itertools
import re
from functools import lru_cache

# Labelled exemplars, one a line.
SERVER = """
(400 bad request|401 unauthorized|403 forbidden|404 not found|405 method not allowed|408 request timeout|410 gone|413 payload too large|429 too many requests)
(500 internal server error|501 not implemented|502 bad gateway|503 service unavailable|504 gateway timeout|520 web server returned an unknown error)
(error|http status) (404|500|503)
the requested (url|resource|page|document) was not found on this server
the (page|document|file|article|content|resource) you (requested|are looking for) (could not be found|is not on this server|does not exist|has been moved or deleted)
sorry, this page (does not exist|is not available|cannot be found)
the (server|proxy) received an invalid response from the upstream server
the server encountered an internal error and was unable to complete your request
the server is (busy|overloaded|temporarily unavailable), try again in a few minutes
the service is temporarily unavailable, please try again later
server error, please try again in a few minutes
the (server|site|host) (took too long|is taking too long) to respond
the connection (has timed out|was reset|was refused)
request timed out, request id
error establishing a database connection
(connection to the database failed|could not connect to the database), the administrator has been notified
database error code, contact the administrator
oops, something went wrong while loading the page
something went wrong, go back to the (home|start) page
an (unexpected|unknown|internal) error (has occurred|occurred)
there has been a critical error on this website
checking your browser before accessing the site
please wait while we (verify|check) (your browser|that you are human)
this process is automatic, your browser will redirect shortly
complete the captcha to prove that you are human
your session has (expired|timed out), please (log in|sign in) again to continue
you have been logged out due to inactivity
you must (log in|sign in) to (view|read) this page
access denied, you do not have permission to (access|view|open) this page
you do not have permission to (access|view|open) this (document|file|page)
access denied, incident id
you don't have permission to access this resource on this server
your ip address has been blocked
you have sent too many requests, please slow down and try again in 60 seconds
too many requests from your (address|network)
rate limit exceeded, retry after 30 seconds
(down|unavailable) for scheduled maintenance, check back soon
the (site|system) is undergoing maintenance
your (file|document|download|report) is being prepared, (please wait|check back later)
(the page|content) is loading, please wait
traceback (most recent call last)
(template|templatesyntaxerror) (rendering|render) failed at line
the view didn't return a response object, it returned none instead
unhandled exception at line in template
(fatal error|uncaught exception|undefined variable|stack trace|syntax error) in file on line
nullpointerexception at line
segmentation fault core dumped
dns server could not be found
this site can't be reached
(erreur 404|erreur) la page (demandée|que vous recherchez) est introuvable
page (introuvable|non trouvée)
la page que vous (avez demandée|cherchez) (n'existe pas|n'existe plus|a été déplacée)
(erreur interne du serveur|erreur du serveur)
le service est momentanément indisponible, veuillez réessayer plus tard
une erreur (est survenue|s'est produite) sur le serveur
votre session a expiré, veuillez vous reconnecter
accès refusé, vous n'avez pas l'autorisation d'accéder à cette page
le site est en maintenance
seite nicht gefunden
die (gewünschte|angeforderte|aufgerufene) seite (existiert nicht|wurde nicht gefunden|wurde verschoben)
das (gewünschte|angeforderte) dokument (existiert nicht|wurde verschoben)
(interner serverfehler|serverfehler)
der dienst ist vorübergehend nicht verfügbar, bitte versuchen sie es später erneut
es ist ein (unerwarteter|interner) fehler aufgetreten
ihre sitzung ist abgelaufen, bitte melden sie sich erneut an
zugriff verweigert, sie haben keine berechtigung
die website wird derzeit gewartet
página no encontrada
la página (solicitada|que busca) no existe, vuelva al (inicio|índice)
error interno del servidor
el servicio no está disponible temporalmente, inténtelo de nuevo más tarde
se ha producido un error (inesperado|interno)
su sesión ha (caducado|expirado), inicie sesión de nuevo
acceso denegado, no tiene permiso para ver esta página
sitio en mantenimiento
(errore 404|errore) la pagina (richiesta|cercata) non è stata trovata
pagina non trovata
errore interno del server
servizio temporaneamente non disponibile
la sessione è scaduta, effettua nuovamente l'accesso
página não encontrada
a página (solicitada|que procura) não existe
erro interno do servidor
serviço temporariamente indisponível
a sua sessão expirou
pagina niet gevonden
de (opgevraagde|gevraagde) pagina (bestaat niet|kan niet worden gevonden)
interne serverfout
ошибка 404 страница не найдена
запрашиваемая страница (не существует|не найдена|была удалена)
внутренняя ошибка сервера
сервис временно недоступен, попробуйте позже
ваша сессия истекла, войдите снова
strona nie została znaleziona
找不到(網頁|頁面|該頁面|您要的頁面)
(您要瀏覽的|您所請求的|您要找的)(網頁|頁面)(不存在|可能已移除|已移除|已被刪除)
(伺服器|系統)(發生錯誤|內部錯誤|忙碌中|暫時無法使用|維護中)，請稍後再試
服務暫時無法使用
連線(逾時|已中斷)，請重新整理
您的(連線|登入)已逾時，請重新登入
存取被拒，您沒有權限瀏覽此網頁
系統維護中
找不到(网页|页面)
(您访问的|您请求的)(网页|页面)(不存在|已删除|可能已被移除)
(服务器|系统)(发生错误|内部错误|繁忙|维护中)，请稍后再试
服务暂时不可用
连接(超时|已断开)，请刷新
访问被拒绝，您没有权限
ページが見つかりません
お探しのページは(見つかりません|移動または削除されました)
サーバーエラーが発生しました
ただいまメンテナンス中です
페이지를 찾을 수 없습니다
"""
SCRIPT = """
javascript is (required|disabled|not enabled|turned off) in your browser
(please enable|enable|turn on|allow|activate|you need to enable|you must enable) (javascript|scripts|scripting|active content) (to continue|to view this page|in your browser|and reload the page|to use this site)
you (need|must|have) to turn (on javascript|javascript on|on scripts) to (use|view|read) this (website|page|app)
this (site|page|application|app) (requires|needs) (javascript|scripting|javascript and cookies)
this (site|page|application) does not work without (javascript|scripting|scripts)
(javascript|cookies) must be (enabled|allowed|turned on)
your browser does not support (javascript|scripts)
javascript is required
(veuillez activer|activez|vous devez activer) javascript (pour afficher cette page|pour continuer|dans votre navigateur)
javascript est (désactivé|nécessaire|requis) dans votre navigateur
votre navigateur ne prend pas en charge (javascript|les scripts)
(bitte aktivieren sie|aktivieren sie|sie müssen) javascript (aktivieren|um diese seite anzuzeigen|um fortzufahren|in ihrem browser)
javascript ist (deaktiviert|erforderlich|ausgeschaltet) in ihrem browser
ihr browser unterstützt kein javascript
(active|habilite|debe activar|es necesario activar) (javascript|los scripts) (para ver esta página|para continuar|en su navegador)
su navegador no (admite|soporta) (javascript|scripts)
(este sitio|esta página) (requiere|necesita) javascript
(javascript está desactivado|los scripts están desactivados) en su navegador
(attiva|abilita) javascript nel (tuo browser|browser) per (continuare|visualizzare la pagina)
javascript è disattivato nel browser
(ative|habilite) o javascript no seu navegador para continuar
schakel javascript in om deze pagina te bekijken
(включите|необходимо включить) javascript в браузере
請(啟用|開啟) javascript (以瀏覽本頁|以繼續|才能瀏覽本網站)
(您的瀏覽器|瀏覽器)(不支援|未啟用|已停用) javascript
(本|此)(網頁|網站|頁面)需要(啟用 javascript| javascript)
请(启用|开启) javascript (以继续|才能浏览本网站)
(您的浏览器|浏览器)(不支持|未启用|已禁用) javascript
javascript を有効にしてください
"""
STANDIN = """
(text|content|copy) (to follow|to be supplied|to come|to be added|coming soon|pending)
(placeholder|sample|dummy|filler) text
(this is|here goes) (placeholder|sample|dummy) text, (replace before publication|delete before publishing|to be replaced)
(insert|add|enter|type|write) (your|the) text here
your (text|headline|content) (goes here|here)
click here to (add|edit) text
delete this (text|paragraph) before (publication|publishing)
texte (à compléter|à venir|provisoire|d'exemple|de remplissage|fictif)
ceci est un texte (d'exemple|provisoire|fictif)
le (contenu|texte) définitif (sera ajouté plus tard|est à venir)
(dies ist|hier steht) ein (blindtext|platzhaltertext|beispieltext|mustertext)
(blindtext|platzhalter|platzhaltertext|mustertext), wird (später|noch|vor der veröffentlichung) ersetzt
text folgt
este es un texto de (ejemplo|relleno|muestra)
texto (de ejemplo|de relleno|provisional|pendiente)
(será sustituido por el|a la espera del) (texto|contenido) definitivo
(questo è un testo|testo) (di esempio|segnaposto)
(este é um texto|texto) (de exemplo|provisório)
это (текст-заполнитель|пример текста)
(此為|這是|此處為)(範例文字|假文|示意文字|佔位文字)
(正式|完整)(內容|文字)(稍後|日後)(補上|更新)
內容(待補|準備中|建置中)
(此为|这是|此处为)(示例文字|占位文字|样本文字)
内容(待补|准备中|建设中)
これはダミーテキストです
(xxxx xxxx|xxx xxxx xx)
asdf asdf
bla bla bla
test test test
"""
#: The dummy Latin of printers.
FILLER = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum
perspiciatis unde omnis natus accusantium doloremque laudantium totam aperiam eaque quae illo inventore veritatis architecto beatae vitae explicabo nemo quia aspernatur fugit consequuntur magni dolores ratione sequi nesciunt neque porro quisquam dolorem quam
"""
#: Spans between opening signs that templates use; ``*`` is a free name. The sign, not the name, tells.
SYNTAX = """
{{*}} {%*%} {#*#} {!*!} #{*} ${*} <%*%> <?*?> <<*>> [[*]] &lt;*&gt; {*} @@*@@ %%*%% __*__ @*@ %*% ~*~ $*$ #*#
"""
#: Orders to a writer, in any bracket; what they order may follow.
COMMAND = """
insert
(insert|enter|type|add|fill in|put) (here|name|text|date|title|value)
fill in
(todo|tbc|tbd|tba|fixme)
to be (confirmed|completed|supplied|determined|added|announced|inserted)
to follow
placeholder
(not set|unset|undefined)
(your|his/her) (name|text|title|company|address) here
(name|text|date|title) here
à (compléter|confirmer|insérer|définir|remplir|renseigner)
(einfügen|ergänzen|ausfüllen|einsetzen|eintragen|hier einfügen)
(insertar|completar|rellenar|por confirmar|por completar)
(inserire|completare|da confermare|da compilare)
(inserir|preencher|a confirmar)
(invoegen|invullen)
(вставить|заполнить|указать)
(請填入|請輸入|請填寫|待填|待補|待確認|填入)
(请填入|请输入|请填写|待补|待确认)
(入力してください|未定)
"""
#: Names of fields, alone in a bracket.
FIELD = """
(first|last|full|your|company|customer|client|recipient|sender|user) name
(firstname|lastname|fullname|username|surname|recipient|sender|addressee|salutation)
(your|start|end|due|today's|insert) date
(email|street|postal|your) address
(phone|invoice|order|account|reference|page) number
(job|document|section|your) title
(zip|postal) code
(nom|prénom|nom de famille|nom et prénom)
(vorname|nachname|name des empfängers)
(nombre|apellido|nombre y apellidos)
(姓名|您的姓名|日期|標題|地址)
"""


@lru_cache(maxsize=None)
def expanded(block: str) -> tuple[str, ...]:
    """The exemplars of a block, alternatives multiplied out."""
    out: dict[str, None] = {}
    for line in block.strip().splitlines():
        parts = [p.split("|") for p in re.split(r"[()]", line)]
        for choice in itertools.product(*parts):
            out[" ".join("".join(choice).split())] = None
    return tuple(out)
