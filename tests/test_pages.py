from shelfspark.operators import pages

CARDS = {
    "Naheed": """<ul><li class="item product product-item"><a class="product-item-photo" href="/x/9">
      <img class="product-image-photo" src="/i.jpg"></a><h2 class="product name product-item-name">
      <a class="product-item-link" href="https://www.naheed.pk/tea-9">  Tea &amp; Milk\n 250g </a></h2>
      <div class="price-box" data-product-id="55"><span class="price">Rs. 1,250</span></div></li>
      <li class="item product product-item"><a class="product-item-link" href="/cola/77">Cola</a>
      <input type="hidden" name="price" value="99.5"></li></ul>""",
    "Metro": """<div class="CategoryGrid_product_nameAndPricing_div__FwOEW">
      <p class="CategoryGrid_product_name__3nYsN" title="Rice 5kg">Ri..</p>
      <p class="CategoryGrid_product_price__Svf8T">Rs. 2,000.50</p><a href="/detail/rice/31">go</a></div>""",
    "Imtiaz": """<div id="product-item-363"><h4 title="Oil 1L">Oil</h4>
      <div class="hazle-product-item_product_item_price_label__ET_we"><span>Rs. 600</span></div>
      <a href="/p/oil"><img data-src="//cdn.example/o.png"></a></div>""",
    "Carrefour": """<div class="relative w-[134px] max-w-[134px] sm:w-[215px] flex"><a href="/en/p/295592?q=1">
      <img src="https://c.example/i.png"></a><div class="text-sm leading-4 font-medium"><span>Nuggets 1 kg
      </span></div><div class="text-lg leading-5 font-bold">1,750</div><div class="text-2xs">.50</div></div>""",
}


def cards(spark):
    rows = [(i, site, f"<html><body><p>Rs 7</p>{html}</body></html>")
            for i, (site, html) in enumerate(CARDS.items())]
    df = spark.createDataFrame(rows, "page_id int, site string, html string")
    return {(r["site"], r["card_no"]): r for r in pages.extract_cards(df).collect()}


def test_cards_of_each_store(spark):
    got = cards(spark)
    assert len(got) == 5
    tea = got["Naheed", 0]
    assert (tea["title"], tea["price"], tea["product_id"]) == ("Tea & Milk 250g", 1250.0, "55")
    assert tea["product_url"] == "https://www.naheed.pk/tea-9"
    assert tea["image_url"] == "https://www.naheed.pk/i.jpg"
    cola = got["Naheed", 1]
    assert (cola["price"], cola["product_id"], cola["image_url"]) == (99.5, "77", None)
    rice = got["Metro", 0]
    assert (rice["title"], rice["price"], rice["product_id"]) == ("Rice 5kg", 2000.5, "31")
    oil = got["Imtiaz", 0]
    assert (oil["title"], oil["product_id"], oil["image_url"]) == (
        "Oil 1L", "363", "https://cdn.example/o.png")
    food = got["Carrefour", 0]
    assert (food["title"], food["price"], food["product_id"]) == ("Nuggets 1 kg", 1750.5, "295592")


def test_fields_stay_inside_their_element(spark):
    pricing = "CategoryGrid_product_nameAndPricing_div__FwOEW"
    price = "CategoryGrid_product_price__Svf8T"
    naheed = """<ol><li class="product-item"><a class="product-item-link" href="/a/1">A</a>
      <span class="price"></span><span class="qty">12 left</span></li>
      <li class="product-item"><div><div class="price-box"><div></div><b><i></i></b>Rs. 40</div></div></li>
      <li class="product-item"><ul><li>x</li></ul><span class="price">Rs. 7</span></li>
      <li class="product-item"><a class="product-item-link" href="/d/4">D</a></li></ol>
      <footer>Delivery Rs. 999</footer>"""
    metro = f"""<div class="{pricing}"><p class="{price}"></p><a href="/x/5">5 in stock</a></div>
      <div class="{pricing}"><p class="{price}">Rs. 8</p><a href="/x/6">x</a>"""
    df = spark.createDataFrame([(1, "Naheed", naheed), (2, "Metro", metro)],
                               "page_id int, site string, html string")
    got = {(r["site"], r["card_no"]): r["price"] for r in pages.extract_cards(df).collect()}
    assert got == {("Naheed", 0): None, ("Naheed", 1): 40.0, ("Naheed", 2): 7.0, ("Naheed", 3): None,
                   ("Metro", 0): None, ("Metro", 1): 8.0}


def test_whole_texts_and_nested_cards(spark):
    naheed = """<!-- <li class="product-item">no</li> --><script>var a = '<li class="product-item">';</script>
      <ul><li class="product-item"><a class="product-item-link" href="/a/1">Tea <b>Gold</b> 500g</a>
        <span class="price"><i>Rs.</i> 1,<b>250</b></span>
        <ul><li class="other">x</li><li class="product-item"><a class="product-item-link" title="Inner &amp; 2"
          href="/b/2?x=1&amp;y=2"><img src="/i.png"/></a><span class="price">soon</span>
          <span class="price">Rs. 9</span></li></ul>
        <span class="price">Rs. 3</span></li>
      <li class='x' data-y="a > b"><div class="product-item">Rs <a href="/c/3">C <br>&lt;1&gt; l</a></p></div></ul>"""
    df = spark.createDataFrame([(1, "Naheed", naheed), (2, "Naheed", None), (3, "Nobody", naheed), (4, "Naheed", "")],
                               "page_id int, site string, html string")
    got = [(r["card_no"], r["title"], r["price"], r["product_url"], r["image_url"])
           for r in pages.extract_cards(df).orderBy("page_id", "card_no").collect()]
    shop = "https://www.naheed.pk"
    assert got == [(0, "Tea Gold 500g", 1250.0, f"{shop}/a/1", None),
                   (1, "Inner & 2", 9.0, f"{shop}/b/2?x=1&y=2", f"{shop}/i.png"),
                   (2, "C <1> l", None, f"{shop}/c/3", None)]


def test_links_around_cards(spark):
    card = '<div class="CategoryGrid_product_nameAndPricing_div__FwOEW"><p>x</p></div>'
    html = (f'<a href="/other/1">o</a><a href="/d/11">{card}</a><a href="/d/12">{card}</a>'
            f'<i>{card}<a href="/d/13"><img src="/i.png"></a></i>{card}')
    df = spark.createDataFrame([(1, "Metro", html)], "page_id int, site string, html string")
    got = {r["card_no"]: (r["product_id"], r["image_url"]) for r in pages.extract_cards(df).collect()}
    assert got == {0: ("11", None), 1: ("12", None),
                   2: ("13", "https://www.metro-online.pk/i.png"), 3: (None, None)}


def test_links(spark):
    html = ('<a href="/catalog/fresh-fruit"><img title="x"></a><a href="/catalog/a/b">Deep</a>'
            '<a href="/catalog/fresh-fruit">Again</a><a href="/about" title="About us">..</a>'
            '<a class="btn btn-primary" href="/list?p=2">Next Page</a>')
    df = spark.createDataFrame([(1, "https://s.example/home", html), (2, "https://s.example/", "<p>")],
                               "page_id int, url string, html string")
    links = pages.category_links(df, within="/catalog/", depth=2).collect()
    assert [(r["link"], r["name"]) for r in links] == [
        ("https://s.example/catalog/fresh-fruit", "Fresh Fruit")]
    names = {r["link"]: r["name"] for r in pages.category_links(df).collect()}
    assert names["https://s.example/about"] == "About us" and len(names) == 4
    got = [(r["page_id"], r["next_link"]) for r in pages.next_page_link(df).collect()]
    assert got == [(1, "https://s.example/list?p=2")]
