"""Page templates that the labeller never trains on; those of FRESH were first tried when its training was settled. In each, {c0} to {c9} stand for content and {o0} to {o9} for other parts."""

TEMPLATES = {
    "plain": "<header><p>{o0}</p></header><nav><ul><li><a href=/>{o1}</a></li><li><a href=/b>{o2}</a></li></ul></nav><article><h1>{c0}</h1><p>{c1}</p><p>{c2}</p><p>{c3}</p></article><aside><p>{o3}</p></aside><footer><p>{o4}</p></footer>",
    "lists": "<nav><a href=/>{o0}</a> </nav><article><h1>{c0}</h1><p>{c1}</p><ul><li>{c2}</li><li>{c3}</li></ul><blockquote>{c4}</blockquote><p>{c5}</p></article><footer>{o1}</footer>",
    "table": "<header>{o0}</header><main><h1>{c0}</h1><p>{c1}</p><table><tr><th>{c2}</th><td>{c3}</td></tr><tr><td>{c4}</td><td>{c5}</td></tr></table><pre>{c6}</pre></main><footer><ul><li>{o1}</li><li>{o2}</li></ul></footer>",
    "headings": "<div class='navbar top'><span>{o0}</span><a href=x>{o1}</a></div><main><article><h1>{c0}</h1><h2>{c1}</h2><p>{c2}</p><h3>{c3}</h3><p>{c4}</p><h2>{c5}</h2><p>{c6}</p></article></main><section class=comments><p>{o2}</p><p>{o3}</p></section>",
    "definitions": "<nav><ol><li><a href=/>{o0}</a></li></ol></nav><article><h2>{c0}</h2><dl><dt>{c1}</dt><dd>{c2}</dd><dt>{c3}</dt><dd>{c4}</dd></dl></article><aside><ul><li>{o1}</li></ul></aside><footer><div>{o2}</div></footer>",
    "divs": "<div class=header><h1>{o0}</h1></div><div class='post content'><h1>{c0}</h1><div>{c1}</div><div>{c2}</div><p>{c3}</p></div><div class=sidebar><h3>{o1}</h3><p>{o2}</p></div><div class=footer><p>{o3}</p></div>",
    "advert inside": "<header><a href=/>{o0}</a></header><article><h1>{c0}</h1><p>{c1}</p><div class='ads'><p>{o1}</p></div><p>{c2}</p><ol><li>{c3}</li><li>{c4}</li></ol><p>{c5}</p></article><form><label>{o2}</label><button>{o3}</button></form><footer><p>{o4}</p></footer>",
    "notice first": "<div class='cookie notice'><p>{o0}</p><button>{o1}</button></div><nav><a href=/>{o2}</a></nav><main><section><h2>{c0}</h2><p>{c1}</p><blockquote><p>{c2}</p></blockquote></section><section><h2>{c3}</h2><p>{c4}</p></section></main><footer><small>{o3}</small></footer>",
    "no body": "<nav><ul><li>{o0}</li><li>{o1}</li></ul></nav><article><p>{c0}</p><figure><figcaption>{c1}</figcaption></figure><pre><code>{c2}</code></pre><p>{c3}</p></article><section class='comments'><ul><li><p>{o2}</p></li></ul></section>",
    "wrapped": "<div class=page><div class=wrapper><header><div><p>{o0}</p></div></header><div class=container><article class=entry><header></header><h1>{c0}</h1><p>{c1}</p><p>{c2}</p><h4>{c3}</h4><p>{c4}</p></article><aside class=side><div><p>{o1}</p></div></aside></div><footer><p>{o2}</p></footer></div></div>",
}

FRESH = {
    "late menu": "<main><h2>{c0}</h2><p>{c1}</p><ul><li>{c2}</li></ul><p>{c3}</p></main><nav><p><a href=/>{o0}</a></p><p><a href=/c>{o1}</a></p></nav><aside><p>{o2}</p><p>{o3}</p></aside><footer><span>{o4}</span></footer>",
    "two asides": "<aside><div>{o0}</div></aside><article><p>{c0}</p><table><tr><td>{c1}</td></tr><tr><td>{c2}</td></tr></table><blockquote>{c3}</blockquote></article><aside><h3>{o1}</h3><ul><li>{o2}</li></ul></aside>",
    "promo and form": "<div class=masthead><h1>{o0}</h1></div><div class=story><h3>{c0}</h3><p>{c1}</p><div class=promo><a href=/x>{o1}</a></div><pre>{c2}</pre><p>{c3}</p></div><form class=subscribe><p>{o2}</p></form><div class=copyright>{o3}</div>",
}
