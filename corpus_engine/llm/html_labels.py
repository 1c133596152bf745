"""Labelled pages from which the extraction model learns.

``data-keep`` on an element says whether it and what stands in it belong to the main text; elements inside may say
otherwise. W stands for one word, so that only structure and lengths teach.
"""

S = "W W W W W W W W."
P = " ".join([S] * 4)
LONG = " ".join([S] * 9)
MENU = "".join('<li><a href="#">W</a></li>' for _ in range(5))
LINKS = "".join('<li><a href="#">W W W W W W</a></li>' for _ in range(5))

PAGES = [
    # A plain news page.
    f"""<body><header data-keep="0"><div><a href="#">W</a></div><nav><ul>{MENU}</ul></nav></header><main data-keep="1"><article>
    <h1>W W W W W</h1><p>{P}</p><p>{P}</p><p>W W.</p><p>{S}</p><h2>W W</h2><p>{LONG}</p></article></main>
    <aside data-keep="0"><h3>W W</h3><ul>{LINKS}</ul></aside><footer data-keep="0"><p>&copy; W W W</p><ul>{MENU}</ul></footer></body>""",
    # Advert between menu and article, short paragraphs.
    f"""<body><nav data-keep="0"><ul>{MENU}</ul></nav><div class="ad" data-keep="0">{S}</div><article data-keep="1"><h1>W W W</h1>
    <p>W.</p><p>W W W.</p><p>{P}</p><p>W <a href="#">W</a> W W.</p></article><footer data-keep="0">&copy; W W &middot; {S}</footer></body>""",
    f"""<body><nav data-keep="0"><ul>{MENU}</ul></nav><div class="ad" data-keep="0">{P}</div><article data-keep="1"><h1>{S}</h1>
    <p>{S}</p><p>{S}</p><p>{LONG}</p></article><footer data-keep="0">&copy; W W &middot; {S}</footer></body>""",
    # A blog with reader comments.
    f"""<body><div id="header" data-keep="0"><h1><a href="#">W W</a></h1><p>W W W</p></div><div id="content" data-keep="1"><div class="post">
    <h2>W W W W</h2><div class="entry"><p>{P}</p><ul><li>{S}</li><li>{S}</li></ul><blockquote><p>{S}</p></blockquote><p>{P}</p></div>
    <div class="share" data-keep="0"><a href="#">W</a> <a href="#">W</a></div></div>
    <div id="comments" data-keep="0"><h3>W W</h3><ol><li><div>W W</div><p>{S}</p></li><li><div>W W</div><p>{P}</p></li></ol></div></div>
    <div id="sidebar" data-keep="0"><ul>{LINKS}</ul><p>{S}</p></div><div id="footer" data-keep="0"><p>W W W W</p></div></body>""",
    f"""<body><article data-keep="1"><header><h1>W W W W</h1><p>W W W</p></header><p>{P}</p><p>{P}</p><footer data-keep="0"><p>W W W</p></footer></article>
    <section class="comments" data-keep="0"><h2>W W</h2><article><p>{P}</p></article><article><p>{S}</p></article><form><label>W</label><button>W</button></form></section></body>""",
    # No semantic elements, boxes only.
    f"""<body><div class="menu" data-keep="0"><a href="#">W</a> <a href="#">W</a></div><div data-keep="1"><h1>W W W</h1><p>{P}</p><p>{LONG}</p><p>{S}</p></div>
    <div class="related" data-keep="0"><h4>W W</h4><ul>{LINKS}</ul></div><div class="copyright" data-keep="0">&copy; W W</div></body>""",
    f"""<body><div data-keep="0"><ul>{MENU}</ul></div><div data-keep="1"><div><div><h1>W W</h1><p>{LONG}</p><p>{LONG}</p></div></div></div><div data-keep="0"><p>&copy; W W W</p></div></body>""",
    # Notices, forms and dialogs.
    f"""<body><div class="cookie-banner" data-keep="0"><p>{P}</p><button>W</button></div><div role="dialog" data-keep="0"><p>{S}</p></div>
    <main data-keep="1"><h1>W W W</h1><p>{P}</p><form data-keep="0"><p>{S}</p><label>W W</label><button>W</button></form><p>{P}</p>
    <div class="newsletter" data-keep="0"><p>{S}</p></div><p>{S}</p></main><dialog data-keep="0"><p>{S}</p></dialog><footer data-keep="0"><p>{S}</p></footer></body>""",
    f"""<body><div class="alert" data-keep="0">{S}</div><section class="content" data-keep="1"><h1>W W</h1><p>{P}</p><aside data-keep="0"><p>{P}</p></aside>
    <p>{P}</p><nav data-keep="0"><ol>{MENU}</ol></nav></section><div id="subscribe" data-keep="0"><h3>W W</h3><p>{S}</p></div><p hidden data-keep="0">{S}</p></body>""",
    # Tables, lists, code and figures in the text.
    f"""<body><nav data-keep="0">{MENU}</nav><article data-keep="1"><h1>W W</h1><table><tr><th>W</th><th>W</th></tr><tr><td>W</td><td>W W</td></tr></table>
    <pre>W W W W</pre><figure><figcaption>{S}</figcaption></figure><dl><dt>W</dt><dd>{S}</dd></dl><ol><li>{S}</li><li>W W</li></ol><h3>W</h3><p>{P}</p></article></body>""",
    # Text right in the page, and in one box.
    f"""<body><p data-keep="1">{P}</p><p data-keep="1">{P}</p><p data-keep="1">{S}</p></body>""",
    f"""<body><h1 data-keep="1">W W W</h1><p data-keep="1">{LONG}</p><ul data-keep="0">{MENU}</ul></body>""",
    f"""<body><div data-keep="1">{LONG}</div><div data-keep="0"><a href="#">W W</a> <a href="#">W</a></div></body>""",
    # Adverts and related boxes inside the article.
    f"""<body><header class="site-header" data-keep="0"><p>W W</p></header><article class="post" data-keep="1"><h1>W W W</h1><p>{P}</p>
    <div class="advert" data-keep="0"><p>{S}</p></div><p>{P}</p><div class="sponsored" data-keep="0"><h4>W W</h4><p>{P}</p></div><p>{P}</p>
    <section><h2>W W</h2><p>{P}</p><div><p>{S}</p></div></section></article><div class="sidebar" data-keep="0"><div class="widget"><p>{S}</p><ul>{LINKS}</ul></div></div></body>""",
]
