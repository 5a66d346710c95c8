import json

import pytest
from pyspark.sql import functions as F

from strataframe.functions import arrow, xslt

HEAD = '<xsl:stylesheet version="1.0" xmlns:xsl="http://www.w3.org/1999/XSL/Transform" xmlns:t="http://t.org/" exclude-result-prefixes="t">'
XML = '<root><title>A &amp; B</title><ws><w id="1">x</w><w id="2" k="v">y<i>z</i></w><w id="10"> </w></ws><empty /></root>'


def run(body, xml=XML, method="xml"):
    return xslt.transform(xml, f'{HEAD}<xsl:output method="{method}"/>{body}</xsl:stylesheet>')


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("", "A &amp; Bxyz "),
        ('<xsl:template match="*[not(*) and not(normalize-space())]"/><xsl:template match="title"><b><xsl:value-of select="."/></b></xsl:template>', "<b>A &amp; B</b>xyz"),
        ('<xsl:template match="/"><r><xsl:for-each select="root/ws/w[normalize-space()]"><xsl:if test="position() &gt; 1">, </xsl:if><xsl:value-of select="@id"/></xsl:for-each></r></xsl:template>', "<r>1, 2</r>"),
        ('<xsl:template match="/"><xsl:apply-templates select="//w"><xsl:sort select="@id" data-type="number" order="descending"/></xsl:apply-templates></xsl:template><xsl:template match="w"><xsl:value-of select="concat(@id, \';\')"/></xsl:template>', "10;2;1;"),
        ('<xsl:template match="root"><xsl:choose><xsl:when test="ws/w[@k=\'v\']">yes</xsl:when><xsl:otherwise>no</xsl:otherwise></xsl:choose></xsl:template>', "yes"),
        ('<xsl:template match="root"><xsl:call-template name="n"><xsl:with-param name="p" select="count(ws/w)"/></xsl:call-template></xsl:template><xsl:template name="n"><xsl:param name="p"/><xsl:param name="q" select="\'d\'"/><xsl:value-of select="$p * 2"/><xsl:value-of select="$q"/></xsl:template>', "6d"),
        ('<xsl:template match="@*|node()"><xsl:copy><xsl:apply-templates select="@*|node()"/></xsl:copy></xsl:template><xsl:template match="title"/>', '<root><ws><w id="1">x</w><w id="2" k="v">y<i>z</i></w><w id="10"> </w></ws><empty /></root>'),
        ('<xsl:template match="root"><a href="#{ws/w[2]/@id}-{{x}}"><xsl:attribute name="n"><xsl:value-of select="last()"/></xsl:attribute></a></xsl:template>', '<a href="#2-{x}" n="1" />'),
        ('<xsl:template match="root"><t:e><xsl:element name="t:f"/></t:e></xsl:template>', '<t:e xmlns:t="http://t.org/"><t:f /></t:e>'),
        ('<xsl:variable name="g" select="\'G\'"/><xsl:template match="root"><xsl:variable name="v"><xsl:value-of select="$g"/>!</xsl:variable><xsl:value-of select="$v"/></xsl:template>', "G!"),
        ('<xsl:template match="root"><xsl:apply-templates select="title" mode="m"/></xsl:template><xsl:template match="title">no</xsl:template><xsl:template match="title" mode="m"><xsl:comment>c</xsl:comment><xsl:copy-of select="../ws/w[2]/i"/></xsl:template>', "<!--c--><i>z</i>"),
        ('<xsl:template match="ws/w[1]"><one/></xsl:template><xsl:template match="w"><any/></xsl:template><xsl:template match="title"/>', "<one /><any /><any />"),
        ('<xsl:template match="i"><xsl:value-of select="name(..)"/><xsl:value-of select="count(ancestor::*)"/><xsl:value-of select="../preceding-sibling::w[1]/@id"/><xsl:value-of select="boolean(../following-sibling::w)"/></xsl:template><xsl:template match="text()"/>', "w31true"),
        ('<xsl:template match="root"><xsl:value-of select="translate(substring-after(title, \'A\'), \' &amp;\', \'-\')"/>|<xsl:value-of select="substring(title, 1, 1)"/>|<xsl:value-of select="string-length(title) mod 3"/>|<xsl:value-of select="5 div 2"/></xsl:template>', "--B|A|2|2.5"),
    ],
)
def test_transform(body, want):
    assert run(body) == want


def test_methods_and_errors():
    assert run('<xsl:template match="/"><p><br/><i/>&lt;</p></xsl:template>', method="html") == "<p><br><i></i>&lt;</p>"
    assert run('<xsl:template match="/">&lt;<xsl:text> a </xsl:text></xsl:template>', method="text") == "< a "
    assert run("", xml="not xml") is None
    for bad in ('<xsl:template match="/"><xsl:number/></xsl:template>', '<xsl:template match="a["/>', '<xsl:template match="/"><xsl:value-of select="f(x)"/></xsl:template>', "<xsl:key/>"):
        with pytest.raises(ValueError):
            run(bad)


def test_stylesheet_over_json(spark):
    sheet = f'{HEAD}<xsl:template match="root"><p><xsl:for-each select="items/item"><xsl:value-of select="@n"/><xsl:value-of select="name"/></xsl:for-each></p></xsl:template></xsl:stylesheet>'
    df = spark.createDataFrame([(json.dumps({"items": [{"name": "a<"}, {"name": "b"}]}),), ("x",), (None,)], "j string")
    got = [r[0] for r in df.select(arrow.xslt_filter(sheet, arrow.XmlOptions(numbered=True))(F.col("j"))).collect()]
    assert got == ["<p>1a&lt;2b</p>", None, None]
    got = [r[0] for r in df.select(arrow.xslt_filter(sheet, paths=("root.{items: items[1:]}",))(F.col("j"))).collect()]
    assert got == ["<p>b</p>", None, None]
