"""A small table of labelled text blocks, from which the block classifier learns.

A line is a block: the elements around it, its words ("." at the end if it is a
sentence), how many of these are links, and 1 if it is main text.  Pages are
apart by an empty line.  Blocks that follow each other share the elements that
their paths have in common, but for the last one.
"""

from __future__ import annotations

from collections.abc import Iterator

#: The attribute that marks main text in a rendered page; the reader of pages only passes it on.
MARK = "data-labelled-main"

LABELLED = """
header/p 6 0 0
header/nav/ul/li 1 1 0
header/nav/ul/li 2 2 0
div.ad 9. 0 0
article/h1 9 0 1
article/p 45. 0 1
article/p 3. 0 1
article/p 60. 6 1
article/p 1. 0 1
footer 12. 0 0

nav/ul/li 1 1 0
nav/ul/li 1 1 0
div.ad 14. 0 0
article/h1 2 0 1
article/p 2. 0 1
footer 9. 0 0

div#header/h1 3 3 0
div#header/p 8. 0 0
div.menu/ul/li 2 2 0
div.menu/ul/li 1 1 0
div#content/div.post/h2 7 0 1
div#content/div.post/p 55. 4 1
div#content/div.post/p 8. 0 1
div#content/div.post/ul/li 6 0 1
div#content/div.post/ul/li 4 0 1
div#content/div.post/p 70. 0 1
div#content/div.share/span 2 2 0
div#content/div.related/ul/li 8 8 0
div#content/div.related/ul/li 9 9 0
div#comments/h3 2 0 0
div#comments/div.comment/p 40. 0 0
div#comments/div.comment/p 65. 0 0
div#sidebar/h3 2 0 0
div#sidebar/p 45. 2 0
div#sidebar/ul/li 3 3 0
div#footer/p 20. 3 0

table/tr/td/div 2 2 0
table/tr/td/div 2 2 0
table/tr/td/div 1 1 0
table/tr/td/p 60. 0 1
table/tr/td/p 40. 3 1
table/tr/td/p 4. 0 1
table/tr/td/p 52. 0 1

div/span 1 1 0
div/div 2 2 0
div/div 1 1 0
section/h1 6 0 1
section/p 38. 0 1
section/p 5. 0 1
section/p 47. 9 1
section/p 2. 0 1
section/p 61. 0 1
div/div 3 3 0
div/div 2 2 0
div/p 7 1 0

h1 5 0 1
p 30. 0 1
p 6. 0 1
h2 3 0 1
p 44. 5 1
ul/li 7. 0 1
ul/li 9. 0 1
p 25. 0 1

body 90. 0 1

ul/li 1 1 0
ul/li 2 2 0
ul/li 1 1 0
h1 4 0 1
p 33. 0 1
p 28. 2 1
p 41. 0 1
ul/li 2 2 0
ul/li 3 3 0

div.cookie-consent/p 26. 2 0
header/nav/span 1 1 0
main/h1 6 0 1
main/section/p 50. 0 1
main/section/p 12. 0 1
main/section/h2 3 0 1
main/section/p 80. 10 1
main/aside/p 30. 0 0
main/aside/ul/li 5 5 0
main/form/p 15. 0 0
main/section/blockquote/p 22. 0 1
main/section/figure/figcaption 9 0 1
main/section/table/tr/td 2 0 1
main/section/table/tr/td 3 0 1
footer/p 80. 0 0
footer/ul/li 2 2 0

div.notice/p 20. 0 0
article/header/h1 8 0 1
article/header/p 14. 0 1
article/div.ad/p 11. 0 0
article/p 66. 0 1
article/div.newsletter/p 18. 0 0
article/p 42. 0 1
article/ul/li 4 4 1
article/ul/li 5 5 1
article/p 9. 9 1
article/footer/p 12. 4 0
article/section.comments/article.comment/p 50. 0 0
article/section.comments/article.comment/p 4. 0 0
aside/article/h3 6 6 0
aside/article/p 25. 0 0

form/div.content/h1 5 0 1
form/div.content/p 48. 0 1
form/div.content/p 31. 0 1
form/div/p 6 6 0

div.breadcrumb/span 3 3 0
div.entry-content/p 3. 0 1
div.entry-content/p 34. 0 1
div.entry-content/pre 40 0 1
div.entry-content/p 5 5 1
div.entry-content/dl/dt 2 0 1
div.entry-content/dl/dd 12. 0 1
div.pagination/span 4 4 0
div.sidebar/div.content/p 40. 0 0
div.popup/p 30. 0 0

div/div/p 3 3 0
div/div/p 4 4 0
div/div/div/h2 6 0 1
div/div/div/p 29. 0 1
div/div/div/p 36. 7 1
div/div/div/p 3. 0 1
div/div/div/p 51. 0 1
div/ul/li 6 6 0
div/ul/li 7 7 0
div/ul/li 5 5 0
div/small 8 2 0

p 5 5 0
p 6 6 0
div/h3 4 0 1
div/div 36. 0 1
div/div 58. 3 1
div/div 24. 0 1
p 9 4 0

td/span 2 2 0
td/span 3 3 0
td/font/p 77. 0 1
td/font/p 18. 1 1
td/font/p 39. 0 1
td/div 5 5 0
center 8 3 0

div.article/p 21. 0 1
div.article/p 1. 0 1
div.comments/p 90. 0 0
div.comments/p 33. 0 0
div.comments/p 2. 0 0
div.footer 15. 0 0

div.topbar 7 2 0
main/article/p 15. 0 1
main/article/div.promo/p 22. 0 0
main/article/div.share/p 3 3 0
main/article/p 7. 0 1
main/div.related/p 24. 24 0
div 16. 0 0
div/p 12. 1 0

header/div/p 11. 0 0
section.intro/p 10. 0 0
article/div/div/p 19. 0 1
article/div/div/h3 2 0 1
article/div/div/p 27. 11 1
article/div/div/p 8 8 1
section/p 21. 3 0
section/ul/li 2 2 0

nav/ul/li 1 1 0
article/h1 5 0 1
article/p 30. 0 1
article/p 22. 0 1
article/p 4. 0 1
section/h3 3 0 0
section/p 25. 0 0
section/p 31. 0 0
div/p 14. 0 0
div/p 20. 0 0
div/div 8. 0 0
footer/p 6 0 0

div/p 30. 0 0
div/p 28. 0 0
main/h1 3 0 1
main/div.a/p 20. 0 1
main/div.b/p 3. 0 1
main/div.c/div.d/p 41. 0 1
main/div.e/div 1. 0 1
div.f/p 35. 0 0
div.g/p 12. 0 0
div.h/p 5 0 0

header/p 3 0 0
div/div/h1 4 0 1
div/div/p 30. 0 1
div/div/p 2. 0 1
div/div/p 26. 1 1
div.sidebar/p 33. 0 0
div.sidebar/p 12. 0 0
div.footer/p 9. 1 0

div/a/span 4 4 0
div.k/p 46. 0 1
div.l/p 62. 3 1
div.m/p 35. 0 1
div.n/p 7 2 0
div.o/p 5 0 0

div#masthead/p 4. 0 0
div.content/p 12. 0 1
div.content/p 18. 12 1
div.content/ol/li 5 0 1
div.content/ol/li 3 3 1
div.extra/p 16. 0 0
div.extra/p 11. 0 0
ul/li 3 3 0

article/p 8 8 1
article/p 12 6 1
article/p 17. 0 1
div/p 9. 0 0
article/div.tags/span 2 2 1
section/p 40. 0 0

article/h2 3 0 1
article/p 13. 0 1
div.widget/p 13. 0 0
article/table/tr/td 1 0 1
article/table/tr/td 1 1 1
article/table/tr/th 2 0 1
div/div/p 33. 0 0

article/h1 4 0 1
article/p 20. 0 1
section.comments/p 90. 0 0
section.comments/p 140. 0 0
section.comments/p 75. 0 0
section.comments/p 2. 0 0

div/h1 3 0 1
div/p 18. 0 1
div/p 9. 0 1
div.comments/p 70. 0 0
div.comments/p 120. 0 0
div.comments/div.comment/p 60. 0 0

p 10. 0 1
p 14. 0 1
footer/p 200. 0 0
footer/p 60. 2 0

table/tr/td 2 2 0
table/tr/td 3 2 0
table/tr/td 2 1 0
table/tr/td/p 70. 15 1
table/tr/td/p 35. 10 1
table/tr/td/p 50. 0 1

p 4 4 0
p 7 6 0
p 50. 14 1
p 28. 9 1
p 33. 0 1
ul/li 2 2 0
ul/li 4 4 0

div.cookie/p 80. 2 0
div.cookie/p 20. 0 0
div.content/p 10. 0 1
div.content/p 6. 0 1

div.modal/p 60. 0 0
div.modal/p 35. 0 0
div/p 12. 0 1
div/p 15. 0 1
aside/p 90. 0 0
aside/p 40. 0 0

p 1. 0 1

div 3 0 1

body 2 0 1

p 40. 0 1

div/p 2 0 1

article/h1 4 0 1
article/p 35. 0 1
article/p 28. 2 1
div/p 20. 0 0
div/p 18. 5 0
div/p 12. 1 0
section/h3 2 0 0
section/p 26. 3 0
section/p 31. 2 0

div/ul/li 1 1 0
div/ul/li 2 2 0
div/div.a/p 12. 0 1
div/div.b/p 30. 1 1
div/div.c/p 4. 0 1
div/div.d/p 18. 0 1
div/div.e/p 55. 0 1
div/div.f/p 9. 0 1
section/div.g/p 3 3 0
section/div.h/p 4 4 0
div.i/p 6 0 0

div.j/div.a/h1 4 0 1
div.j/div.b/div 25. 0 1
div.j/div.c/div 3. 0 1
div.j/div.d/div 44. 6 1
div.j/div.e/div 12. 0 1
div.k/div.a/div 5 5 0
div.k/div.b/div 4. 0 0
div.k/div.c/div 9 2 0
"""


def _element(step: str) -> tuple[str, str]:
    """The start of an element like ``div.name`` or ``div#name``, and its tag."""
    tag, _, name = step.replace("#", ".").partition(".")
    kind = "id" if "#" in step else "class"
    return (f'<{tag} {kind}="{name}"' if name else f"<{tag}"), tag


def rendered(table: str) -> Iterator[str]:
    """The pages of a table as HTML."""
    for page in table.strip().split("\n\n"):
        out: list[str] = []
        held: list[str] = []
        for line in page.splitlines():
            path, words, linked, main = line.split()
            steps = path.split("/")
            same = 0
            while same < min(len(steps), len(held)) - 1 and steps[same] == held[same]:
                same += 1
            out += [f"</{_element(s)[1]}>" for s in reversed(held[same:])]
            for i in range(same, len(steps)):
                last = i == len(steps) - 1
                out.append(_element(steps[i])[0] + (f" {MARK}" if last and main == "1" else "") + ">")
            n, k = int(words.rstrip(".")), int(linked)
            out.append((f"<a href=x>{' '.join(['words'] * k)}</a>" if k else "") + " " + " ".join(["words"] * (n - k)) + ("." if words.endswith(".") else ""))
            held = steps
        yield "".join(out)
