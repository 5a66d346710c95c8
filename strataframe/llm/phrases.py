"""What pages say in place of content: short phrases by language, in families, for the automaton of residue.

`core` phrases say that something failed, is required or is filler; one of them must be there. `context` is what such
notices speak of besides: pages, servers, browsers, sessions, and how they address the reader. `small` words say nothing
and count neither way. `filler` is filler by itself. A word with `-` at its end may go on by a few letters, as filler Latin does.
"""

#: fixed values: notices in English
EN = {
    "core": """
not found
404 not found
could not be found
cannot be found
can't be found
couldn't find
could not find
was not found
were not found
no longer exists
no longer exist
no longer available
does not exist
doesn't exist
not available
currently unavailable
temporarily unavailable
unavailable
not accessible
has been removed
have been removed
been moved or removed
may have been removed
has been deleted
has moved
may be broken
could not be loaded
could not be opened
could not be processed
could not be completed
could not be displayed
could not be retrieved
could not complete
cannot be displayed
cannot be shown
cannot be loaded
cannot be opened
cannot be reached
can't be reached
couldn't be loaded
failed to load
failed to open
failed to fetch
failed to retrieve
retrieval failed
loading failed
unable to load
unable to open
unable to connect
unable to complete
unable to display
error loading
encountered an error
error occurred
error has occurred
unexpected error
internal error
internal server error
server error
application error
fatal error
uncaught
connection error
connection refused
connection reset
connection failure
connection timed out
connection was interrupted
connect error
timed out
has expired
session expired
session has expired
session timed out
went wrong
try again
please retry
try refreshing
try later
access denied
access is denied
has been denied
access to this page has been denied
permission to access
don't have permission
not authorized
unauthorized
forbidden
has been blocked
bad request
bad gateway
gateway timeout
gateway time out
service unavailable
request timeout
too many requests
too many redirects
http error
status gone
gone
reached the limit
unusual traffic
must be logged in
please log in
log in again
sign in again
sign in to continue
under maintenance
down for maintenance
scheduled maintenance
out of service
be back soon
back shortly
apologise for the inconvenience
apologize for the inconvenience
sorry for the inconvenience
isn't working
not working
please wait
just a moment
may take a few seconds
are human
are not a robot
not a robot
security check
checking your browser
checking if the site
refresh the page
reload the page
refresh your browser
reload your browser
if the problem persists
if the problem continues
oops
enable javascript
enable scripts
enable scripting
enable cookies
allow scripts
allow cookies
allow javascript
turn on javascript
turn on scripting
turn on scripts
turn them on
switch on javascript
enable it
uses javascript
requires javascript
requires scripts
require javascript
javascript required
javascript is required
javascript is disabled
javascript disabled
javascript must be enabled
javascript to be enabled
without javascript
support javascript
supports javascript
supports scripts
support scripts
blocks active content
out of date
runs scripts
scripts must be allowed
nothing happens
traceback most recent call last
stack trace
nullpointerexception
exception in thread
typeerror
keyerror
cannot read properties
at line
delete this line
no results
disconnect before headers
failed to respond
""",
    "context": """
page
pages
site
website
web
url
link
file
files
document
documents
publication
record
full text
text
view
viewer
reader
content
contents
resource
results
server
network
connection
browser
browsers
javascript
java
script
scripts
scripting
cookie
cookies
session
login
log
sign
password
database
administrator
admin
owner
support
contact
operator
home
menu
search
help
form
settings
request
requested
requests
error
errors
code
message
status
detail
http
https
html
head
body
title
noscript
null
undefined
object
function
reference
ref
id
please
sorry
we
we're
our
you
you're
your
again
later
few
minutes
moment
time
times
today
now
soon
continue
proceed
click
refresh
reload
retry
return
back
try
check
checking
enable
enabled
allow
allowed
disable
disabled
turn
switch
update
open
opening
load
loading
display
shown
access
accessing
visit
use
using
used
read
wait
seconds
problem
trying
occurred
unexpected
looking
followed
typo
address
secure
verify
complete
tick
box
quote
below
skip
inconvenience
maintenance
performing
interrupted
until
limit
traffic
noticed
feature
supports
require
requires
required
needs
need
active
date
temporarily
currently
properly
may
side
within
upstream
reset
reason
headers
index
length
type
main
store
gone
exception
call
recordexception
service
exists
available
application
app
work
works
unavailable
removed
moved
deleted
broken
""",
    "small": "the a an this that these those is are was were be been has have had to of in on at for from by with and or if it its as no not do does did can could will would should there here so but into because about out any all more than then when",
}
#: fixed values: notices in German
DE = {
    "core": """
nicht gefunden
wurde nicht gefunden
nicht gefunden werden
existiert nicht
existiert nicht mehr
nicht mehr vorhanden
nicht mehr verfügbar
nicht verfügbar
steht nicht zur verfügung
nicht zur verfügung
nicht erreichbar
vorübergehend nicht erreichbar
wurde gelöscht
wurde entfernt
wurde verschoben
verschoben oder gelöscht
nicht geladen werden
konnte nicht geladen
nicht geöffnet werden
nicht angezeigt werden
nicht dargestellt werden
nicht verarbeitet werden
fehler aufgetreten
ist ein fehler aufgetreten
unerwarteter fehler
interner fehler
interner serverfehler
serverfehler
fehler beim laden
schief gelaufen
schiefgelaufen
zugriff verweigert
wurde verweigert
keine berechtigung
nicht berechtigt
zugang verweigert
ist abgelaufen
leider abgelaufen
oder abgelaufen
sitzung ist abgelaufen
versuchen sie es
später erneut
später noch einmal
erneut an
wieder ein
melden sie sich
loggen sie sich
wartungsarbeiten
in wartung
überlastet
zu viele anfragen
ungültige anfrage
bitte warten
wird geladen
seite neu
neu laden
laden sie die seite
bitten um entschuldigung
keine verbindung
verbindung wurde unterbrochen
wurde unterbrochen
zurück zur suche
zurück zur startseite
kein roboter
aktivieren sie javascript
aktivieren sie cookies
aktivieren sie skripte
aktivieren sie bitte
bitte aktivieren
javascript ist deaktiviert
javascript aktivieren
schalten sie bitte
schalten sie javascript
unterstützt kein javascript
benötigt javascript
erfordert javascript
ohne skripte
ohne javascript
skripte zulassen
müssen skripte
wenden sie sich
ist ungültig
""",
    "context": """
seite
seiten
webseite
website
internetseite
link
adresse
datei
dokument
dokumente
volltext
volltextanzeige
text
inhalt
inhalte
veröffentlichung
dienst
system
server
verbindung
netzwerk
browser
javascript
java
skript
skripte
scripte
cookies
sitzung
anmeldung
datenbank
administrator
anfrage
fehler
fehlercode
suche
startseite
anzeige
anzuzeigen
anzeigen
angeforderte
angeforderten
gewünschte
gewünschten
gesuchte
bitte
leider
entschuldigung
entschuldigen
sie
ihr
ihre
ihren
ihrem
wir
uns
erneut
später
noch
einmal
moment
momentan
derzeit
zurzeit
aktuell
vorübergehend
fortzufahren
zuzugreifen
zugriff
laden
geladen
warten
anmelden
aktivieren
deaktiviert
benötigt
möglich
erlaubt
erlauben
dargestellt
bestätigen
daher
wegen
wieder
wurde
wurden
zurück
neu
ungültig
abgelaufen
""",
    "small": "der die das den dem des ein eine einen einem einer ist sind war wird werden hat haben kann können muss müssen zu zur zum im in an auf für von vom mit und oder um es dies diese dieser dieses nicht kein keine keinen nach bei dass sich aufgrund oben am",
}
#: fixed values: notices in French
FR = {
    "core": """
introuvable
page introuvable
est introuvable
n'existe pas
n'existe plus
n'a pas été trouvé
n'a pas été trouvée
pas été trouvée
non trouvée
non trouvé
n'est pas disponible
n'est plus disponible
non disponible
pas disponible
indisponible
temporairement indisponible
momentanément indisponible
inaccessible
a été supprimé
a été supprimée
a été déplacé
a été déplacée
déplacé ou supprimé
n'a pas pu être chargé
n'a pas pu être chargée
pas pu être
ne peut pas être affiché
ne peut pas être affichée
peut pas être affiché
impossible d'afficher
impossible de charger
impossible d'ouvrir
impossible de se connecter
une erreur est survenue
erreur est survenue
une erreur s'est produite
erreur inattendue
erreur s'est produite
s'est produite
erreur interne
erreur serveur
accès refusé
accès interdit
n'avez pas l'autorisation
pas autorisé à
a expiré
session a expiré
a pris fin
veuillez réessayer
merci de réessayer
réessayer plus tard
réessayer ultérieurement
réessayez
vous reconnecter
vous identifier
veuillez vous
en maintenance
maintenance en cours
trop de requêtes
requête invalide
n'a pas abouti
a échoué
veuillez patienter
chargement en cours
recharger la page
recharger cette page
rechargez la page
retour à la recherche
retour à l'accueil
si le problème persiste
pas un robot
activer javascript
activer les cookies
activer les scripts
d'activer
veuillez activer
nécessite javascript
exige que les scripts
scripts soient autorisés
javascript est désactivé
charge javascript
sans javascript
est incorrect
nous excuser
excusez-nous
oups
""",
    "context": """
page
site
lien
adresse
fichier
document
texte intégral
texte
contenu
publication
ressource
service
serveur
connexion
réseau
navigateur
javascript
script
scripts
cookies
session
base de données
administrateur
requête
erreur
code
recherche
recherchez
accueil
demandé
demandée
désolé
désolée
désolés
veuillez
merci
vous
votre
vos
nous
nos
contactez
accéder
accès
afficher
chargement
charger
continuer
patienter
quelques
instants
réessayer
activer
autorisés
autorisation
actuellement
momentanément
temporairement
nouveau
identifier
confirmez
inattendue
exige
charge
prend
suivi
problème
incorrect
""",
    "small": "le la les un une des de du d l à au aux en sur dans pour par avec et ou que qui ce cette ces est sont a ont été être ne pas plus n s il elle y pour êtes avez prend",
}
#: fixed values: notices in Japanese
JA = {
    "core": """
見つかりません
見つかりませんでした
存在しません
表示できません
表示できませんでした
読み込めません
読み込みに失敗
取得できません
開けません
利用できません
利用いただけません
アクセスできません
接続できません
エラーが発生しました
サーバーエラー
サーバエラー
予期しないエラー
通信エラー
アクセスが拒否されました
アクセスが集中
権限がありません
タイムアウトしました
期限が切れました
期限切れです
再度ログイン
もう一度ログイン
再度お試し
もう一度お試し
再度アクセス
しばらくしてから
しばらく経ってから
しばらくお待ちください
お待ちください
メンテナンス中
停止しております
削除されたか
移動した可能性
再読み込みしてください
更新してください
リクエストが多すぎ
申し訳ございません
申し訳ありません
ご確認ください
確認してください
有効にしてください
有効にしてご利用
有効にする必要
無効になっています
javascriptが無効
許可してください
対応していません
ロボットではない
ご連絡ください
お問い合わせください
""",
    "context": """
ページ
サイト
ファイル
文献
文書
本文
コンテンツ
サービス
サーバー
サーバ
システム
接続
通信
ブラウザ
ブラウザー
スクリプト
javascript
java
cookie
クッキー
セッション
ログイン
エラー
リクエスト
アクセス
メンテナンス
指定された
要求された
お探しの
お使いの
ご不便
ご利用
お手数
ただいま
現在
一時的に
しばらく
もう一度
再度
正しいか
管理者
お問い合わせ
ご連絡
設定
発生しました
表示する
を表示するには
この
には
まで
ため
内部
可能性があります
読み込み中
url
http
有効
有効期限
""",
    "small": "の を は が に で と も へ や か た です ます でした ました 中",
}
#: fixed values: notices in Chinese
ZH = {
    "core": """
不存在
找不到
未找到
无法访问
无法显示
无法打开
无法加载
无法连接
加载失败
打开失败
连接失败
操作失败
请求失败
访问失败
服务器错误
服务器内部错误
内部错误
未知错误
连接错误
发生错误
出错了
错误代码
没有权限
无权访问
访问被拒绝
拒绝访问
已过期
已超时
超时
已失效
已删除
已被删除
已下架
不可用
暂停服务
系统繁忙
稍后再试
稍后重试
请重试
再试
点击重试
后重试
请稍候
请稍等
重新登录
维护中
敬请期待
过于频繁
请刷新
请启用
请开启
启用浏览器脚本
开启javascript
启用javascript
不支持javascript
支持脚本
已禁用
请联系管理员
联系管理员
安全验证
返回首页
对不起
抱歉
""",
    "context": """
页面
网页
网站
文件
文档
文献
全文
内容
资源
链接
服务器
服务
系统
网络
连接
数据库
浏览器
浏览
脚本
javascript
java
cookie
会话
登录
错误
请求
访问
加载
打开
查看
显示
刷新
检查
继续
完成
您的
您访问的
您要查看的
您
该
请
后
后再
本页面
需要
暂时
正在
相关
管理员
首页
点击
升级
返回
操作
或
""",
    "small": "的 了 在 是 与 和 或 已 被 中 以 并",
}
#: fixed values: filler, of whatever language
FILLER = """
lorem-
ipsum-
veniam-
nostrud-
ullam-
adipis-
eiusmod
exercitation ullamco
commodo
consequat
duis
aute
irure
reprehenderit
voluptate
velit
cillum
fugiat
pariatur
excepteur
sint
occaecat
cupidatat
proident
sunt
culpa
officia
deserunt
mollit
pellentesque
habitant
morbi
tristique
senectus
netus
malesuada
fames
turpis
egestas
vestibulum
primis
faucibus
luctus
ultrices
posuere
cubilia
curae
vivamus
aliquam
mauris
vulputate
sollicitudin
praesent
phasellus
curabitur
suspendisse
maecenas
quisque
sagittis
bibendum
tincidunt
placeholder text
dummy text
filler text
sample text
example text
blind text
text goes here
text here
insert text
add text
your text
your own wording
your own text
replace it with
replace this paragraph
replace this text
with your own
sample paragraph
example paragraph
this is a sample
layout purposes
show the layout
final wording
demo line
type the body
short summary of your
blindtext
mustertext
platzhaltertext
beispieltext
fülltext
dummytext
ihr text
text einfügen
beschreibung einfügen
texte de remplissage
texte fictif
texte factice
texte de substitution
exemple de texte
votre texte
à remplacer avant publication
faux texte
ダミーテキスト
ダミー文章
ダミーの
ダミーです
サンプルテキスト
入力してください
文字の大きさを確認
示例文字
示例文本
样本文字
占位文字
占位文本
输入正文
请输入
请在此输入
在这里输入
在此输入
asdf
asdfgh
sdfg
qwer
qwerty
fdsa
hjkl
jkl
quick brown fox
quick sample fox
jumps over the lazy dog
fox jumps
one two three four
paragraph text
test test
tbd tbd
todo todo
blah blah
text text
content content
undefined undefined
object object
"""
#: fixed values: what stands beside filler
FILLER_CONTEXT = """
dolor-
amet-
consec-
tempor-
incid-
labor-
magna-
aliq-
sit
elit
ut
et
ad
quis
consectetur
minim
nisi
sed
this is
text
texte
test
paragraph
content
description
the
your
own
only
here
it
keep it below words
nothing to see in this
before release
will be added
write
of your invention
invention
section
in this box
when done
layout
gestaltung
dient nur der
dies ist ein
hier steht
hier
ceci est un
ici
これは
テキスト
この文章は
文字
ために
入れています
ここに
文章
此处
正文
摘要
这是一段
标题
内容
""".strip()
LANGUAGES = (EN, DE, FR, JA, ZH)
