"""Path expressions against the standard library's element trees and a plain walk."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pytest

from webloom.operators import regions
from webloom.sources import dom

PAGES = [
    (1, "<html><body><div id='a' class='x y'><p>1</p><p class='x'>2</p><div><p id='q'>3</p><span><p>4</p></span></div></div><nav><p>5</p></nav></body></html>"),
    (2, "<html><body><main><div><div id='b'><div class='crumbs breadcrumb'><ul><li>a</li><li>b</li><li>c</li></ul></div></div></div></main><div>e</div></body></html>"),
    (3, ""),
]


@pytest.fixture(scope="module")
def nodes(spark):
    pages = spark.createDataFrame([(i, "u", h) for i, h in PAGES], "page_id long, url string, html string")
    return dom.nodes(pages).cache()


def plain(path):
    """(page, nid) by ElementTree, which knows a part of the expressions; nids count elements in order."""
    out = set()
    for page, html in PAGES:
        if html:
            root = ET.fromstring(html.replace("<html>", "<top><html>").replace("</html>", "</html></top>"))
            numbers = {el: i - 1 for i, el in enumerate(root.iter())}
            out |= {(page, numbers[el]) for el in root.findall("." + path)}
    return out


@pytest.mark.parametrize("path", [
    "//p", "/html/body/div", "//div//p", "//div/p", "//*[@id='a']/p[2]", "//div[@id]", "//div//div", "//li[last()]", "//ul/li[2]", "//*[@class='x']", "//main//div/div//li", "//p[1]", "/html/body/div[1]/div",
    "//body/*", "//div[@id='a']//span/p", "//table", "//div[@id='b'][1]",
])
def test_paths_lead_where_element_trees_do(nodes, path):
    found = [tuple(r) for r in regions.select_nodes(nodes, path).collect()]
    assert set(found) == plain(path) and len(found) == len(set(found))


def test_more_predicates(nodes):
    count = lambda path: regions.select_nodes(nodes, path).count()
    assert count("//*[contains(@class, 'breadcrumb')]") == 1 and count("//div[starts-with(@class,'x')]") == 1
    assert count("//div[not(@id)]") == 4 and count("//div[@id='a' or @id='b']") == 2 and count("//*[@id='a' and (@class='x y')]") == 1
    assert count("//p[@class='x'][1]") == 1 and count("//p[2][@class='x']") == 1 and count("//p[1][@class='x']") == 0  # from left to right
    assert count("//p[@id!='z']") == 1 and count("//p[position()=2]") == 1 and count("//*[@id=\"q\"]") == 1


@pytest.mark.parametrize("path", ["", "div", "//div[", "//div[foo()]", "//p/text()", "//p[0]", "//a[@x=1]", "//div[contains(@x)]", "//p | //a"])
def test_other_expressions_are_errors(nodes, path):
    with pytest.raises(ValueError):
        regions.select_nodes(nodes, path)


def test_negative_regions_win(nodes):
    rows = regions.labelled_by_paths(nodes, ["//*[@id='a']", "//main"], ["//*[@id='a']/div", "//ul", "//none"])
    found = {(r.page_id, r.nid): r.label for r in rows.collect()}
    assert {k: v for k, v in found.items() if k[0] == 1} == {(1, 2): 1, (1, 3): 1, (1, 4): 1, (1, 5): 0, (1, 6): 0, (1, 7): 0, (1, 8): 0}
    assert sum(v == 0 for k, v in found.items() if k[0] == 2) == 4 and sum(v == 1 for k, v in found.items() if k[0] == 2) == 4
    assert regions.labelled_by_paths(nodes, [], []).count() == 0


def test_paths_of_nodes_lead_back(nodes):
    paths = {(r.page_id, r.nid): r.path for r in regions.node_paths(nodes).collect()}
    assert len(paths) == nodes.count() and paths[1, 4] == "/html/body/div/p[2]" and paths[2, 9] == "/html/body/main/div/div/div/ul/li[3]"
    for (page, nid), path in paths.items():
        assert (page, nid) in {tuple(r) for r in plain(path)}
