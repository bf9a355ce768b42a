"""Pages written and labelled by hand: (html, the blocks of the main text).

They share no generator with the training pages: real words, other containers and class
names, several page types and languages.
"""

PAGES = [
    (
        """<!doctype html><html lang=en><head><title>Bridge reopens - Valley Courier</title><link rel=stylesheet href=/s.css><script>window.dataLayer=[];</script></head>
<body class="post-template"><div id="masthead"><a href="/">Valley Courier</a></div><ul class="mainnav"><li><a href="/local">Local</a></li><li><a href="/sport">Sport</a></li></ul>
<div class="content-area"><div class="entry"><h1>Bridge reopens after two years</h1><p class="dek">The old crossing is safe again, engineers say.</p>
<p>Hundreds of people walked across the restored bridge on Saturday, two years after a flood closed it.</p>
<p>&ldquo;It feels like getting a neighbour back,&rdquo; said <b>Ana Ruiz</b>, who lives on the east bank.</p>
<ul><li>The repair took 26 months.</li><li>The county paid most of the bill.</li></ul>
<p>Traffic will be limited to light vehicles until spring.</p></div></div>
<div id="comments-area" class="comments"><h3>3 comments</h3><p>Finally! I have been waiting for ages.</p><p>What about the other bridge?</p></div>
<div class="footer-links"><a href="/about">About</a> <a href="/contact">Contact</a></div><div class="copyright">&copy; Valley Courier. All rights reserved.</div></body></html>""",
        ["Bridge reopens after two years", "The old crossing is safe again, engineers say.",
         "Hundreds of people walked across the restored bridge on Saturday, two years after a flood closed it.",
         "“It feels like getting a neighbour back,” said Ana Ruiz, who lives on the east bank.", "The repair took 26 months.", "The county paid most of the bill.",
         "Traffic will be limited to light vehicles until spring."],
    ),
    (
        """<html><body><header role="banner"><nav aria-label="Main"><a href="/">Home</a><a href="/recipes">Recipes</a></nav></header>
<main><article><header><h1>Lentil soup</h1></header><p>A warm soup for cold evenings, ready in forty minutes.</p><h2>Ingredients</h2><ul><li>200 g red lentils<li>1 onion<li>2 carrots</ul>
<h2>Method</h2><ol><li>Fry the onion gently until it is soft.<li>Add the lentils, the carrots and a litre of water, and simmer for half an hour.</ol>
<aside class="promo-box">Get our cookbook for only $9! <a href="/shop">Buy now</a></aside><p>Serve with bread.</p></article></main>
<form action="/subscribe"><label>Your e-mail</label><input><button>Sign up</button></form><footer><p>Privacy policy</p><p>Terms</p></footer></body></html>""",
        ["Lentil soup", "A warm soup for cold evenings, ready in forty minutes.", "Ingredients", "200 g red lentils", "1 onion", "2 carrots", "Method",
         "Fry the onion gently until it is soft.", "Add the lentils, the carrots and a litre of water, and simmer for half an hour.", "Serve with bread."],
    ),
    (
        """<HTML><BODY bgcolor=white><table width=100%><tr><td class=sidebar><a href=a.html>Chapter 1</a><br><a href=b.html>Chapter 2</a><br><a href=c.html>Index</a></td>
<td class=content><h2>Chapter 2. The harbour</h2><p>The harbour lies at the mouth of the river, and was built in 1881.
<p>Its two piers are made of granite, which was brought by sea from the north.<p>Ships of up to 9000 tons can enter at high water.</td></tr></table>
<div class=footer>Last changed 3 May 1999. Contact the webmaster.</div></BODY></HTML>""",
        ["Chapter 2. The harbour", "The harbour lies at the mouth of the river, and was built in 1881.",
         "Its two piers are made of granite, which was brought by sea from the north.", "Ships of up to 9000 tons can enter at high water."],
    ),
    (
        """<!DOCTYPE html><html lang="de"><body><div class="cookie-banner">Wir verwenden Cookies, um Ihnen das beste Erlebnis zu bieten. <button>OK</button></div>
<nav class="hauptnavigation"><ul><li><a href="/politik">Politik</a><li><a href="/kultur">Kultur</a></ul></nav>
<article class="artikel"><h1>Neue Ausstellung im Stadtmuseum</h1><p>Das Stadtmuseum zeigt ab Freitag über 120 Werke aus privaten Sammlungen.</p>
<p>Viele der Bilder waren noch nie öffentlich zu sehen, wie die Leiterin des Hauses erklärte.</p><blockquote>Wir haben drei Jahre an dieser Schau gearbeitet.</blockquote>
<p>Der Eintritt ist am ersten Sonntag im Monat frei.</p></article>
<section class="related-articles"><h3>Mehr zum Thema</h3><a href="/1">Museen in der Region</a><a href="/2">Sammler im Gespräch</a></section><footer>Impressum | Datenschutz</footer></body></html>""",
        ["Neue Ausstellung im Stadtmuseum", "Das Stadtmuseum zeigt ab Freitag über 120 Werke aus privaten Sammlungen.",
         "Viele der Bilder waren noch nie öffentlich zu sehen, wie die Leiterin des Hauses erklärte.", "Wir haben drei Jahre an dieser Schau gearbeitet.",
         "Der Eintritt ist am ersten Sonntag im Monat frei."],
    ),
    (
        """<html><head><style>.x{color:red}</style></head><body><div class="wrapper"><div class="top-bar"><a href=#>Log in</a> <a href=#>Register</a></div>
<div class="breadcrumb"><a href="/">Home</a> &raquo; <a href="/d">Docs</a> &raquo; Install</div><div class="docs-body main-content"><h1>Installation</h1>
<p>Download the archive and unpack it into a folder of your choice.</p><pre>tar xf tool.tar.gz
cd tool</pre><p>Then run the installer, which asks for the target folder and for your licence key.</p><table><tr><th>Option</th><th>Meaning</th></tr><tr><td>-q</td><td>say nothing</td></tr></table>
<p>Restart the machine if the installer asks you to.</p></div><div class="sidebar widget"><h4>On this page</h4><ul><li><a href=#a>Download</a><li><a href=#b>Run</a></ul></div>
<div class="newsletter">Get our monthly newsletter. <input type=email></div></div></body></html>""",
        ["Installation", "Download the archive and unpack it into a folder of your choice.", "tar xf tool.tar.gz cd tool",
         "Then run the installer, which asks for the target folder and for your licence key.", "Option", "Meaning", "-q", "say nothing", "Restart the machine if the installer asks you to."],
    ),
    (
        """<html lang=fr><body><div id=header><h2>Le Petit Journal</h2><p>Toute l'actualité de la vallée</p></div><div id=menu><a href=/>Accueil</a> | <a href=/meteo>Météo</a></div>
<section class="story-text"><h1>Un hiver très doux</h1><p>Jamais un mois de janvier n'avait été aussi chaud depuis le début des relevés.</p><div class="ad-slot">Publicité : -30 % sur les pneus !</div>
<p>Les agriculteurs s'inquiètent, car les arbres fruitiers fleurissent déjà.</p><p>Un retour du gel n'est pas exclu en mars.</p></section>
<div class=share-buttons>Partager : <a href=#>mail</a> <a href=#>lien</a></div><div id=footer>&copy; Le Petit Journal</div></body></html>""",
        ["Un hiver très doux", "Jamais un mois de janvier n'avait été aussi chaud depuis le début des relevés.", "Les agriculteurs s'inquiètent, car les arbres fruitiers fleurissent déjà.",
         "Un retour du gel n'est pas exclu en mars."],
    ),
    (
        """<html><body><div class="forum-header"><a href="/">Garden talk</a></div><div class="notice">You must be logged in to reply.</div>
<div class="post-body"><h1>How do I prune an old apple tree?</h1><p>My tree has not been touched for ten years and is full of crossing branches. When should I start, and how much can I take off at once?</p>
<p>It still bears well, but the fruit is small.</p></div><div class="replies"><div class="reply"><p>Never more than a third a year.</p></div><div class="reply"><p>Late winter is best.</p></div></div>
<p class="legal">Copyright 2019 Garden talk</p></body></html>""",
        ["How do I prune an old apple tree?",
         "My tree has not been touched for ten years and is full of crossing branches. When should I start, and how much can I take off at once?", "It still bears well, but the fruit is small."],
    ),
    (
        """<html lang=es><body><aside class="lateral"><h3>Lo más leído</h3><ol><li><a href=/1>El puerto crece</a><li><a href=/2>Nueva línea de tren</a></ol></aside>
<main id="principal"><h1>La biblioteca abre los domingos</h1><p>Desde octubre, la biblioteca municipal abrirá también los domingos por la mañana.</p>
<p>El horario será de nueve a dos, y habrá actividades para niños.</p><p>La medida costará 40 000 euros al año.</p></main>
<section id="comentarios" class="comments-section"><h2>Comentarios</h2><p>¡Qué buena noticia!</p></section><footer><nav><a href=/aviso>Aviso legal</a></nav></footer></body></html>""",
        ["La biblioteca abre los domingos", "Desde octubre, la biblioteca municipal abrirá también los domingos por la mañana.", "El horario será de nueve a dos, y habrá actividades para niños.",
         "La medida costará 40 000 euros al año."],
    ),
]
