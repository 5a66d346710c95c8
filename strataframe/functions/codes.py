"""Code tables of languages."""

from __future__ import annotations

#: fixed values: ISO 639 languages as three-letter code, two-letter code, name
ISO_639 = """\
aar,aa,Afar
abk,ab,Abkhazian
afr,af,Afrikaans
aka,ak,Akan
alb,sq,Albanian
amh,am,Amharic
ara,ar,Arabic
arg,an,Aragonese
arm,hy,Armenian
asm,as,Assamese
ava,av,Avaric
ave,ae,Avestan
aym,ay,Aymara
aze,az,Azerbaijani
bak,ba,Bashkir
bam,bm,Bambara
baq,eu,Basque
bel,be,Belarusian
ben,bn,Bengali
bih,bh,Bihari
bis,bi,Bislama
bos,bs,Bosnian
bre,br,Breton
bul,bg,Bulgarian
bur,my,Burmese
cat,ca,Catalan
cha,ch,Chamorro
che,ce,Chechen
chi,zh,Chinese
chu,cu,Church Slavic
chv,cv,Chuvash
cor,kw,Cornish
cos,co,Corsican
cre,cr,Cree
cze,cs,Czech
dan,da,Danish
div,dv,Divehi
dut,nl,Dutch
dzo,dz,Dzongkha
eng,en,English
epo,eo,Esperanto
est,et,Estonian
ewe,ee,Ewe
fao,fo,Faroese
fij,fj,Fijian
fin,fi,Finnish
fre,fr,French
fry,fy,Western Frisian
ful,ff,Fulah
geo,ka,Georgian
ger,de,German
gla,gd,Gaelic
gle,ga,Irish
glg,gl,Galician
glv,gv,Manx
gre,el,Modern Greek
grn,gn,Guarani
guj,gu,Gujarati
hat,ht,Haitian
hau,ha,Hausa
heb,he,Hebrew
her,hz,Herero
hin,hi,Hindi
hmo,ho,Hiri Motu
hrv,hr,Croatian
hun,hu,Hungarian
ibo,ig,Igbo
ice,is,Icelandic
ido,io,Ido
iii,ii,Sichuan Yi
iku,iu,Inuktitut
ile,ie,Interlingue
ina,ia,Interlingua
ind,id,Indonesian
ipk,ik,Inupiaq
ita,it,Italian
jav,jv,Javanese
jpn,ja,Japanese
kal,kl,Kalaallisut
kan,kn,Kannada
kas,ks,Kashmiri
kau,kr,Kanuri
kaz,kk,Kazakh
khm,km,Central Khmer
kik,ki,Kikuyu
kin,rw,Kinyarwanda
kir,ky,Kirghiz
kom,kv,Komi
kon,kg,Kongo
kor,ko,Korean
kua,kj,Kuanyama
kur,ku,Kurdish
lao,lo,Lao
lat,la,Latin
lav,lv,Latvian
lim,li,Limburgan
lin,ln,Lingala
lit,lt,Lithuanian
ltz,lb,Luxembourgish
lub,lu,Luba-Katanga
lug,lg,Ganda
mac,mk,Macedonian
mah,mh,Marshallese
mal,ml,Malayalam
mao,mi,Maori
mar,mr,Marathi
may,ms,Malay
mlg,mg,Malagasy
mlt,mt,Maltese
mon,mn,Mongolian
nau,na,Nauru
nav,nv,Navajo
nbl,nr,South Ndebele
nde,nd,North Ndebele
ndo,ng,Ndonga
nep,ne,Nepali
nno,nn,Norwegian Nynorsk
nob,nb,Norwegian Bokmål
nor,no,Norwegian
nya,ny,Chichewa
oci,oc,Occitan
oji,oj,Ojibwa
ori,or,Oriya
orm,om,Oromo
oss,os,Ossetian
pan,pa,Panjabi
per,fa,Persian
pli,pi,Pali
pol,pl,Polish
por,pt,Portuguese
pus,ps,Pushto
que,qu,Quechua
roh,rm,Romansh
rum,ro,Romanian
run,rn,Rundi
rus,ru,Russian
sag,sg,Sango
san,sa,Sanskrit
sin,si,Sinhala
slo,sk,Slovak
slv,sl,Slovenian
sme,se,Northern Sami
smo,sm,Samoan
sna,sn,Shona
snd,sd,Sindhi
som,so,Somali
sot,st,Southern Sotho
spa,es,Spanish
srd,sc,Sardinian
srp,sr,Serbian
ssw,ss,Swati
sun,su,Sundanese
swa,sw,Swahili
swe,sv,Swedish
tah,ty,Tahitian
tam,ta,Tamil
tat,tt,Tatar
tel,te,Telugu
tgk,tg,Tajik
tgl,tl,Tagalog
tha,th,Thai
tib,bo,Tibetan
tir,ti,Tigrinya
ton,to,Tonga
tsn,tn,Tswana
tso,ts,Tsonga
tuk,tk,Turkmen
tur,tr,Turkish
twi,tw,Twi
uig,ug,Uighur
ukr,uk,Ukrainian
urd,ur,Urdu
uzb,uz,Uzbek
ven,ve,Venda
vie,vi,Vietnamese
vol,vo,Volapük
wel,cy,Welsh
wln,wa,Walloon
wol,wo,Wolof
xho,xh,Xhosa
yid,yi,Yiddish
yor,yo,Yoruba
zha,za,Zhuang
zul,zu,Zulu
"""

#: fixed values: names of language tags that ISO 639 lacks or names otherwise
TAGS = """\
arc,Aramaic
cu,Church Slavonic
goh,Old High German
got,Gothic
grc,Ancient Greek
akk,Akkadian
ang,Old English
cop,Coptic
egy,Ancient Egyptian
enm,Middle English
frm,Middle French
fro,Old French
gmh,Middle High German
gml,Middle Low German
hit,Hittite
nds,Low German
non,Old Norse
odt,Old Dutch
ofs,Old Frisian
ota,Ottoman Turkish
peo,Old Persian
pro,Old Provençal
sga,Old Irish
sux,Sumerian
syc,Classical Syriac
xcl,Classical Armenian
xno,Anglo-Norman
"""

#: fixed values: regions of the tags that have one
REGIONS = """\
ar-SA,Saudi Arabia
de-AT,Austria
de-CH,Switzerland
de-DE,Germany
en-AU,Australia
en-CA,Canada
en-GB,United Kingdom
en-IE,Ireland
en-NZ,New Zealand
en-US,United States
en-ZA,South Africa
es-AR,Argentina
es-ES,Spain
es-MX,Mexico
fr-BE,Belgium
fr-CA,Canada
fr-CH,Switzerland
fr-FR,France
it-CH,Switzerland
it-IT,Italy
nl-BE,Belgium
nl-NL,Netherlands
pt-BR,Brazil
pt-PT,Portugal
zh-CN,Simplified
zh-HK,Hong Kong
zh-TW,Traditional
"""


def _pairs(text: str) -> dict[str, str]:
    return dict(line.split(",", 1) for line in text.splitlines())


def iso639(letters: int = 3) -> dict[str, str]:
    """Names by three- or two-letter code."""
    rows = [line.split(",", 2) for line in ISO_639.splitlines()]
    return {r[3 - letters]: r[2] for r in rows if r[3 - letters]}


def bcp47() -> dict[str, str]:
    """Names by lower-case language tag: two-letter codes, other tags, and `Language (Region)` for tags with a region."""
    names = iso639(2) | _pairs(TAGS)
    return {k.lower(): v for k, v in names.items()} | {k.lower(): f"{names[k.split('-')[0]]} ({v})" for k, v in _pairs(REGIONS).items()}
