"""Residue and genuine texts in five languages, written before the lexicon of strataframe.llm.residue was.

Lines with even numbers (from 0) served to look at while the lexicon was written, lines with odd numbers only to measure it.
"""

RESIDUE = """
404 Not Found. The requested URL was not found on this server.
Please turn on scripting in your browser to view this content.
The server encountered an error and could not complete your request.
This site can't be reached. Check if there is a typo in the address.
Your connection was interrupted. Please check your network and reload the page.
We're sorry, but the page you are looking for no longer exists.
This website uses JavaScript. Please enable it to continue.
You don't have permission to access this resource.
The requested document is not available at this time.
An unexpected error occurred. Please try again in a few minutes.
Sorry! This page is currently unavailable.
The link you followed may be broken, or the page may have been removed.
Our site is down for maintenance. We will be back soon.
Enable cookies and reload the page.
Your browser does not support JavaScript.
This content requires JavaScript to be enabled.
Too many redirects occurred trying to open this page.
Session timed out. Please log in again.
You must be logged in to view this document.
Loading, please wait...
The file you requested could not be opened.
Document retrieval failed. Please retry.
504 Gateway Time-out
HTTP Error 500: internal error
Just a moment... Checking if the site connection is secure.
Please complete the security check to access this website.
Your request has been blocked.
This page isn't working. Contact the site owner if the problem continues.
Database connection error. Please contact the administrator.
No results could be loaded. Refresh your browser.
Uncaught TypeError: Cannot read properties of undefined
java.lang.NullPointerException
Fatal error: Call to a member function on null
Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas.
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip.
Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae.
This is placeholder text. Replace it with your own.
The quick brown fox jumps over the lazy dog. The quick brown fox jumps over the lazy dog.
Insert text here
Your text goes here
[YOUR TEXT HERE]
{title}
{{ doc.owner-name }}
TBD TBD TBD
[Enter description]
<Your abstract here>
Click here to add text
Blah blah blah blah blah blah
xxxxxxxxxxxxxxxxxxxxxxxx
{{#if abstract}}{{abstract}}{{/if}}
%(description)s
Diese Seite existiert nicht mehr.
Die Seite konnte nicht gefunden werden.
Fehler 404 – Seite nicht gefunden
Leider ist ein Fehler aufgetreten. Bitte versuchen Sie es erneut.
Der Zugriff wurde verweigert.
Der Server ist derzeit nicht erreichbar.
Ihr Browser unterstützt kein JavaScript.
Bitte aktivieren Sie Cookies in Ihrem Browser.
Diese Website benötigt JavaScript.
Die Verbindung zum Server wurde unterbrochen.
Ihre Sitzung ist leider abgelaufen. Bitte loggen Sie sich wieder ein.
Wegen Wartungsarbeiten ist der Dienst momentan nicht verfügbar.
Das angeforderte Dokument steht nicht zur Verfügung.
Die gewünschte Datei wurde gelöscht.
Sie haben keine Berechtigung, auf diese Seite zuzugreifen.
Es ist ein unerwarteter Fehler aufgetreten.
Bitte laden Sie die Seite neu.
Interner Serverfehler
Zu viele Anfragen. Bitte warten Sie einen Moment.
Um fortzufahren, schalten Sie bitte JavaScript ein.
Bitte warten, die Seite wird geladen ...
Der Inhalt kann ohne Skripte nicht dargestellt werden.
Bitte bestätigen Sie, dass Sie kein Roboter sind.
Dies ist ein Platzhaltertext.
Hier steht Ihr Text. Hier steht Ihr Text.
[Bitte Text einfügen]
[Titel hier eingeben]
Beispieltext Beispieltext Beispieltext Beispieltext
Hier Beschreibung einfügen
Der Link ist ungültig oder abgelaufen.
Ungültige Anfrage
Das System ist zurzeit überlastet. Versuchen Sie es später noch einmal.
Keine Verbindung zur Datenbank
Die Veröffentlichung ist nicht mehr verfügbar.
Bitte wenden Sie sich an den Administrator.
Page introuvable : erreur 404
La page que vous recherchez n'existe plus.
Désolé, une erreur est survenue. Veuillez réessayer.
Accès refusé.
Le serveur est momentanément indisponible.
Votre navigateur ne prend pas en charge JavaScript.
Veuillez activer les cookies de votre navigateur.
Ce site nécessite JavaScript.
Le document demandé n'est pas disponible.
Le fichier a été supprimé.
Vous n'avez pas l'autorisation d'accéder à cette page.
Une erreur inattendue s'est produite.
Veuillez recharger la page.
Erreur interne du serveur
Trop de requêtes. Veuillez patienter quelques instants.
Votre session a pris fin. Merci de vous identifier à nouveau.
Le site est actuellement en maintenance.
Chargement en cours, veuillez patienter...
Le lien que vous avez suivi est incorrect ou a expiré.
Pour continuer, merci d'activer les scripts.
Impossible d'afficher cette page.
La connexion au serveur a échoué.
Confirmez que vous n'êtes pas un robot.
Service temporairement inaccessible
Ceci est un texte fictif.
Votre texte ici
[Saisissez votre texte]
[Titre à compléter]
Texte de substitution texte de substitution
Exemple de texte. Exemple de texte. Exemple de texte.
Contactez l'administrateur du site si le problème persiste.
La requête n'a pas abouti.
Contenu non disponible
Requête invalide
Merci de réessayer ultérieurement.
La publication n'a pas été trouvée.
お探しのページは見つかりませんでした。
ページが見つかりません
サーバーエラーが発生しました。
アクセスが拒否されました。
ただいまアクセスが集中しています。しばらく経ってから再度アクセスしてください。
JavaScriptを有効にしてご利用ください。
お使いのブラウザはJavaScriptに対応していません。
Cookieを有効にしてください。
セッションがタイムアウトしました。もう一度ログインしてください。
現在サービスを停止しております。
このページは削除されたか、移動した可能性があります。
読み込み中です。しばらくお待ちください。
予期しないエラーが発生しました。
文献を取得できませんでした。
ファイルが存在しません。
このコンテンツを表示する権限がありません。
ページを再読み込みしてください。
内部サーバーエラー
ご不便をおかけして申し訳ございません。
システムメンテナンス中のためご利用いただけません。
URLが正しいかご確認ください。
リクエストが多すぎます。
通信エラーが発生しました
ロボットではないことを確認してください。
本文を表示するにはスクリプトを許可してください。
ここに文章を入力してください
【タイトルを入力】
ダミー文章ダミー文章ダミー文章ダミー文章ダミー文章
これはダミーのテキストです。
（ここに要約を入れる）
この文章はダミーです。文字の大きさを確認するために入れています。
お問い合わせは管理者までご連絡ください。
サービスは一時的に利用できません
接続がタイムアウトしました
要求されたURLは見つかりませんでした
エラー：文書を開けません
抱歉，网页无法访问。
页面不存在或已被删除
您没有权限访问该页面
服务器内部错误
网络连接失败，请检查网络后重试。
请开启JavaScript后继续浏览。
您的浏览器不支持JavaScript
请启用Cookie
登录超时，请重新登录。
网站维护中，敬请期待
正在加载，请稍候……
发生未知错误，请联系管理员。
请求的资源不存在
文件已删除
访问被拒绝
服务暂时不可用
请求过于频繁，请稍后重试
该链接已失效
数据库连接错误
请完成安全验证后继续访问
未找到相关文献
文档打开失败
内容加载失败，点击重试
找不到该网页
出错了！请返回首页
系统升级中，暂停服务
您访问的内容已下架
请刷新后再试
本页面需要浏览器支持脚本
此处输入正文
【请填写摘要】
占位文字占位文字占位文字占位文字占位文字占位文字
这是一段示例文本
在这里输入标题
请在此输入内容
测试测试测试测试测试测试测试测试
500 服务器错误
对不起，您要查看的页面已过期
无法打开文件
操作失败，请重试
Page not available
Error loading document
Something went wrong. Try refreshing the page.
Bad Request
401 Unauthorized
Connection timed out
This request could not be processed.
Unable to load the page
Access to this page has been denied.
Please verify that you are not a robot.
Sorry, we couldn't find that page.
We are performing scheduled maintenance.
This feature requires a browser that supports scripts.
Temporarily out of service
[object Object]
undefined undefined undefined
Sample text. Sample text. Sample text.
This text is only here to show the layout.
Replace this paragraph with the description of the invention.
""".strip().split("\n")  # fmt: skip

GENUINE = """
An error message is displayed on the screen when the page cannot be found.
If the server is unavailable, the terminal 12 sends the request to a second server.
The browser executes JavaScript received from the web server 30.
When the session has expired, the user is asked to log in again by the authentication unit 14.
The method of claim 3, wherein an HTTP 404 response causes the crawler to delete the entry.
A loading arm moves the tray into the chamber and waits for the signal.
The maintenance schedule is stored in the memory of the controller.
A retry counter limits how often the client repeats a failed request.
The page buffer holds data that could not be written to the memory cell.
Access to the vault is denied unless the key matches the code.
A document feeder loads sheets which have not been found by the sensor.
The page fault handler loads the missing page from disk.
Cookies are baked in an oven having a conveyor belt.
The script is parsed and each command is checked before execution.
A placeholder token marks the position at which the address is inserted.
The text field shows sample text in the selected font.
The template engine replaces the variable "{{user}}" by the name of the user.
Dummy loads are connected to the output in order to test the amplifier.
The dummy text is replaced when the final layout is known to the printing system.
The word "lorem" is used as a test pattern in the recognition experiment.
The file was not found to contain any errors after the checksum had been verified.
An unexpected pressure drop indicates that the valve is not closed.
The connection between the shaft and the hub is interrupted by a clutch.
The server 5 returns a status code 503 so that the client reduces its rate.
A notice that scripts are required is shown only where the terminal lacks an interpreter.
A captcha image is generated in order to verify that the user is human.
The gateway 7 forwards the packet after a timeout.
The error signal is fed back to the controller until the set value is reached.
The lamp is turned on when the door is opened and turned off when it is closed.
In case of an internal error the motor is stopped and an alarm is output.
Claim 4 was withdrawn by the applicant.
No drawings were filed with the application.
See the corrigendum for the formula, which was lost in conversion.
[Formula 2]
(see FIG. 3)
[0012] A device as above.
Abstract not required.
The title was amended by the examining division.
Figure 4 is not available in text form.
Translation done by machine; no liability is taken.
A nut and a bolt.
The link 8 is broken when the load exceeds the limit.
Please note that the dimensions are given in millimetres.
The plate may have been removed before the cover is closed.
The request queue is emptied, and the worker continues with the next job.
The refresh rate of the page display is reduced while the battery is low.
A robot hand grips the part, and a camera checks its position.
The key field [TITLE] of the table is indexed.
The macro %TITLE% is expanded by the preprocessor 4.
The system administrator sets the limit by means of a form on the website.
A blank form with the words "insert text here" is printed on the card.
The site of the injection is cleaned and the needle is removed.
Wenn die Seite nicht gefunden wird, zeigt das Endgerät 5 eine Fehlermeldung an.
Der Server 3 ist über ein Netzwerk mit dem Browser des Benutzers verbunden.
Die Sitzung wird nach Ablauf einer Frist durch die Steuereinheit beendet.
Das Skript wird vom Interpreter im Browser ausgeführt.
Bei einem Fehler wird der Motor abgeschaltet und eine Warnung ausgegeben.
Die Verbindung zwischen Welle und Nabe wird durch eine Kupplung unterbrochen.
Ein Platzhalter hält den Abstand zwischen den Ringen.
Die Wartung der Anlage erfolgt ohne Unterbrechung des Betriebs.
Der Zugriff auf den Speicher wird verweigert, sofern der Schlüssel nicht passt.
Ein Blindtext dient in der Vorlage als Muster für die Schrifterkennung 6.
Die Datei wurde vom Prüfmodul gelesen, ohne dass Fehler gefunden wurden.
Der Antrag wurde am 3. Mai zurückgezogen.
Zeichnungen liegen nicht vor.
Die Formel ist bei der Übertragung verloren gegangen.
Anspruch 5 entfällt.
Die Platte kann nicht verschoben werden, solange der Riegel geschlossen ist.
Das Dokument wird vom Einzug geladen und abgetastet.
Die Seite der Platte, die nicht geladen ist, liegt an Masse.
Der Benutzer wird gebeten, sich erneut anzumelden, wenn die Karte abgelaufen ist.
Der Text „Bitte warten“ erscheint auf der Anzeige 9, während die Daten geladen werden.
Die Anfrage wird wiederholt, bis der zweite Server antwortet.
Ein Roboter greift das Bauteil und legt es auf das Band.
Die Meldung wird im Protokoll gespeichert und später ausgewertet.
Verfahren nach Anspruch 1, wobei Cookies im Endgerät gespeichert werden.
Der Link zwischen den Gliedern ist gebrochen.
Die Vorrichtung ist mit einem Deckel versehen, der nicht entfernt werden kann.
Ein Beispieltext wird vom Sprecher vorgelesen und vom System analysiert.
Das Feld [Titel] der Maske nimmt bis zu 80 Zeichen auf.
Ein Haken.
Siehe Fig. 2.
Die Erfindung betrifft eine Dichtung für Pumpen.
Der Dienst ist nur für angemeldete Geräte verfügbar.
Lorsque la page est introuvable, le terminal 4 affiche un message d'erreur.
Le serveur 2 est relié au navigateur par un réseau.
La session est fermée par l'unité de commande après un délai.
Le script est exécuté par le navigateur du terminal.
En cas d'erreur, le moteur est arrêté et une alarme est émise.
La connexion entre l'arbre et le moyeu est interrompue par un embrayage.
L'accès à la mémoire est refusé si la clé ne correspond pas.
Un texte de remplissage sert de motif pour la reconnaissance des caractères.
La maintenance de l'installation se fait sans arrêt.
Le fichier est lu par le module de contrôle sans qu'une erreur soit trouvée.
La revendication 3 a été supprimée.
Les dessins ne sont pas disponibles.
La formule a été perdue lors de la conversion.
Demande retirée.
Le document est chargé par l'introducteur et numérisé.
La plaque ne peut pas être déplacée tant que le verrou est fermé.
L'utilisateur est invité à se reconnecter quand la carte a expiré.
La requête est répétée jusqu'à ce que le second serveur réponde.
Un robot saisit la pièce et la pose sur la bande.
Procédé selon la revendication 1, dans lequel des cookies sont stockés.
Le maillon est rompu lorsque la charge dépasse la limite.
L'invention concerne un joint pour pompes.
Le champ [titre] du formulaire reçoit 80 caractères.
Le message « veuillez patienter » est affiché pendant le chargement des données.
Le service n'est disponible que pour les appareils enregistrés.
Un crochet.
Voir la figure 2.
La page du livre est tournée par un bras.
Le chargement de la cuve est effectué par une vis.
Le texte est découpé en mots par l'analyseur 7.
Le compteur d'erreurs est remis à zéro après la lecture.
ページが見つからない場合、端末5はエラーメッセージを表示する。
サーバ3はネットワークを介してブラウザに接続される。
セッションが期限切れになると、制御部は接続を切断する。
スクリプトはブラウザのインタプリタによって実行される。
エラーが発生した場合、モータを停止して警報を出力する。
アクセスが拒否されたとき、認証部4は履歴を記録する。
メンテナンス時期は記憶部に保存される。
図面なし。
請求項3は削除された。
数式は変換時に失われた。
本発明はポンプ用のシールに関する。
ロボットハンドが部品を把持する。
板はかんぬきが閉じている間は移動できない。
原稿は給紙部から読み込まれる。
フック。
図2を参照。
ダミー電極は端部に配置される。
サンプルの温度を測定する。
利用者はログイン画面で再度パスワードを入力する。
要求は第2のサーバが応答するまで繰り返される。
「しばらくお待ちください」という文字が表示部9に表示される。
通信が切断された場合に再接続を行う通信部を備える。
文書を開くためのボタンが画面に設けられる。
ファイルが存在しない場合、新たなファイルを作成する。
クッキーは端末に記憶される。
テンプレートの変数は値に置き換えられる。
ダミーテキストを用いて文字認識の精度を評価した。
ページの余白が削除される。
表示装置はバックライトを有する。
膜の厚さは5μmである。
当页面不存在时，终端5显示错误信息。
服务器3通过网络与浏览器连接。
会话过期后，控制单元断开连接。
脚本由浏览器的解释器执行。
发生错误时，电机停止并输出报警。
访问被拒绝时，认证单元4记录日志。
维护周期存储在存储器中。
无附图。
权利要求3已删除。
公式在转换时丢失。
本发明涉及一种泵用密封件。
机械手抓取零件。
插销关闭时，板不能移动。
原稿由送纸部加载。
一种挂钩。
参见图2。
样品的温度由传感器测量。
用户在登录界面重新输入密码。
重复发送请求，直到第二服务器应答。
显示屏9上显示“请稍候”字样。
连接中断时，通信单元重新连接。
若文件不存在，则创建新文件。
测试单元对电路进行测试。
测试的结果表明，该材料的强度较高。
模板中的变量被替换为数值。
网站的访问量由统计模块计算。
加载失败的数据被重新发送给客户端。
该链接件的一端与轴相连。
页面缓存的大小可以调整。
膜的厚度为5微米。
The drawing sheet 3 was filed later.
Withdrawn.
Not applicable.
Patent text not available in English; see the original.
The text of the description ends here.
1. A pump. 2. The pump of claim 1.
The quick release coupling jumps over the groove.
The valve V1, V2, V3 and V4 are closed; the valve V5 is open.
AAA batteries are held in the tray.
C6H5-CO-NH-CH2-CO-OH
SEQ ID NO: 1 atgcatgcatgcatgcatgcatgcatgc
x = x1 + x2 + x3 + x4 + x5 + x6
The unit 12 is connected to the unit 13, the unit 13 to the unit 14.
A fault in the text line is corrected by the editor, who reloads the page.
The user clicks on a link to add text to the note.
The applicant's name is entered in the field "applicant_name" of the form.
Machine translation may contain errors.
The index entry <title> is closed by </title> in the markup file.
The array a[i] and the map m{key} are initialised.
The undefined value is replaced by zero in the computation of the mean.
In the default layout, paragraphs are replaced by lines in order to save space.
The content of the tank could not be measured, since the float was blocked.
It is not possible to load the spring further once the stop is reached.
The operator is instructed to contact the service if the problem persists.
""".strip().split("\n")  # fmt: skip
