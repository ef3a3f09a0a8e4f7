"""Hand-written pages: page, url, HTML and a header."""

SHOP = """<!DOCTYPE html><html lang="en-GB"><head><title>Blue <b>kettle</b></title><meta name="viewport" content="w"><meta name="Description" content=" A kettle ">
<meta name="keywords" content="Kettle, blue;steel"><meta property="article:tag" content="kitchen"><meta property="og:type" content="product"><meta property="og:site_name" content="Shop Co">
<meta name="robots" content="noindex, follow"><meta name="twitter:card" content="summary"><link rel="canonical" href="/kettle/"><link rel="alternate" hreflang="de" href="/de/kettle/"><link rel="alternate" hreflang="fr" href="//fr.shop.example/k#x">
<link rel="alternate" type="application/rss+xml" href="/feed/"><link rel="next" href="?p=2"><link rel="stylesheet" href="/s.css"><link rel="shortcut icon" href="/i.ico"><link rel="preload" href="/f.woff2">
<script src="/app.js"></script><script src="/app.js">dataLayer = []</script>
<script type="application/ld+json">{"@graph": [{"@type": "Product", "@id": "#k", "offers": [{"price": 24.5, "priceCurrency": "EUR", "availability": "https://schema.org/InStock"}], "aggregateRating": {"ratingValue": "4.5", "ratingCount": 12}},
{"@type": ["Article", "article"], "datePublished": "2024-01-02", "author": [{"name": "Ann"}, "Bo"], "publisher": {"name": "Press"}, "keywords": "Kettle, hot", "genre": ["Home", "home"]}]}</script><script type="application/ld+json">{broken</script></head>
<body class="single product  wide"><nav><a href="/one/">One</a><a href="/one/"> Again </a><a href="https://b.example/">B</a></nav><div role="navigation"><a href="/one/">Once more</a><a href="/two">Two</a></div>
<ol class="Breadcrumbs"><li><a href="/">Home</a></li><li><span>Kettles</span></li></ol><h1>Kettle</h1><h3>Jump</h3><h2> </h2><!-- unseen -->
<p>Last reviewed: 9th May, 2023 and posted on 2023-04-05<p>second <b>bold</b><img src="/a.png" alt=""><img src="b.jpg" alt=" Side view "><img src="/a.png"></p>
<a href="tel:+44 20 1"> Call </a><a href="TEL: ">none</a><a href="/cookies?x">here</a><a href="/doc.PDF">Doc</a><a href="#top">Top</a><a href="mailto:a@b.example">Mail</a><a href="/tag/steel/">Steel</a><a href="/x" rel="tag nofollow">Rel</a><a href="/z"><img src="z.gif" alt=""></a><a href="/y" title=" "></a>
<form role="search"><label for="q">Q</label><input id="q" type="text" autocomplete="on"><input type="email"><input name="free"><input type="submit" value=" "><button></button><button aria-label="Go"></button></form>
<table><tr><td>1</td></tr></table><table><tr><th>2</th></tr></table><div id="d" itemscope itemtype="https://schema.org/Event"><span id="d" itemscope itemtype="https://schema.org/Place"></span></div><div typeof=" schema:Offer ">o</div>
<ul class="Topics"><li>Tea</li></ul><video src="/v.mp4"><source src="/v.webm"></video><audio><source src="/a.mp3"></audio><noscript>no</noscript><style>p{}</style></body></html>"""

NEWS = """<html lang="e"><head><meta property="og:title" content="Flood news"><meta property="article:published_time" content="2022-02-02T10:00"><meta property="og:updated_time" content="2022-03-03"><meta name="Author" content="Cy"></head>
<body class="page-node-type-news_item ghost-x"><a href="#main-content">Skip</a><main><p>Short.</p><p>A river has come over its banks in the north of the country, and roads are closed.</p></main>
<div class="post-date--updated">Updated<span>3 June 2022</span></div><div class="date">July 2021</div><span class="review_day">4 July 2021</span><a href="https://c.example/learn">Learn more</a><a href="http://[bad">odd</a>
<script type="application/ld+json">[{"@type": "Event", "startDate": "2024-06-01", "location": {"address": "Main St"}}, {"@type": "JobPosting", "title": "Nurse", "jobLocation": {"address": {"addressLocality": "Leeds"}}}, {"@type": "Recipe", "cookTime": "PT5M"},
{"@type": "BreadcrumbList", "itemListElement": [{"position": 2, "name": "News"}, {"position": 1, "item": {"name": "Start"}}]}, {"@type": "Thing", "review": {"ratingValue": 3, "reviewCount": 1}}]</script></body></html>"""

BYLINE = """<html><head></head><body><div class="story-byline"> By <b>Di</b> </div><div class="published">on 5 May 2020</div><div class="last-modified">2020-06-07</div><div id="root"></div><link rel="prev" href="/p1"><form><input type="search"></form></body></html>"""

PAGES = ((1, "https://shop.example/p/kettle", SHOP, "noarchive"), (2, "https://news.example/", NEWS, ""), (3, "https://x.example/story", BYLINE, ""), (4, "https://x.example/none", None, ""))
