"""Media references in payloads that hold payloads."""

import json

from fleetlens.operators import media

PAYLOAD = "source string, path string, text string"


def found(spark, rows, bases=()):
    got = media.media_references(spark.createDataFrame(rows, PAYLOAD), bases).collect()
    return sorted((r.source, r.place, r.context, r.path) for r in got)


def php(value):
    return f's:{len(value.encode())}:"{value}";'


def test_strings_go_by_byte_length(one):
    inner = php("file") + php("fake.jpg")
    got = one(media.serialized_strings, t="a:2:{" + php("né") + php(inner) + php("") + 's:99:"wrong length";s:3:"ab')
    assert [s.value for s in got] == ["né", inner, "", "wrong length"]
    assert one(media.serialized_strings, t=None) is None and one(media.serialized_strings, t="s:5:") == []


def test_payloads_inside_payloads(spark):
    leaf = json.dumps({"pic": "deep.svg", "no": "deep.txt"})
    markup = f'<img src="/wp-content/uploads/a.jpg?v=1"><p style="background:url(b.png)"><!-- wp:gallery {leaf} --><!-- wp:x {{"bad": https://h.test/c.gif , }} /-->'
    meta = "a:3:{" + php("file") + php("p-1x1.jpg") + php("note") + php(php("file") + php("fake.jpg")) + php("html") + php('<a href="m.pdf">') + "}"
    doc = json.dumps({"post": {"content": markup, "list": ["e.mp3", "text", {"meta": meta}]}})
    assert found(spark, [("one", "2024/p.jpg", doc)]) == sorted([
        ("one", "post.content", "attribute", "a.jpg"), ("one", "post.content", "style", "b.png"), ("one", "post.content.block[0].pic", "text", "deep.svg"),
        ("one", "post.content.block[1]", "address", "c.gif"), ("one", "post.list[0]", "text", "e.mp3"),
        ("one", "post.list[2].meta", "thumbnail", "2024/p-1x1.jpg"), ("one", "post.list[2].meta.string[5]", "attribute", "m.pdf")])


def test_edges(spark):
    assert found(spark, [("n", None, None), ("e", None, "")]) == []
    same = [("r", None, "x.jpg"), ("r", None, "x.jpg"), (None, None, "{broken https://h.test/y.png")]
    assert sorted(media.media_references(spark.createDataFrame(same, PAYLOAD)).select("raw").toPandas().raw) == ["https://h.test/y.png", "x.jpg", "x.jpg"]
    assert found(spark, [("long", None, "<p>" + "word " * 200_000 + "<img src=z.jpg><img src='z.jpg'>")]) == [("long", "", "attribute", "z.jpg")]
