"""The small labelled table that the block classifier is trained on.

Pages of common layouts, a block a line in page order: keep (1) or not (0),
words, words inside links, and flags: a in an article or main element, p the page
has one, c in page furniture (nav, footer, aside, form, a header outside the
article), h a name such as ad, comments or sidebar on an element around it, t
a heading. Pages are parted by blank lines.
"""

TABLE = """
0 1 1 pc
0 1 1 pc
0 1 1 pc
0 2 2 pc
0 12 0 ph
1 9 0 pat
1 80 0 pa
1 1 0 pa
1 25 5 pa
1 140 2 pa
0 11 0 pc

0 2 2 pc
0 2 2 pc
0 3 3 pc
0 25 0 ph
1 6 0 pat
1 1 0 pa
1 1 0 pa
1 3 0 pa
0 30 1 pc

0 5 0 pc
0 1 1 pc
0 1 1 pc
1 12 0 pat
0 18 4 pah
1 60 0 pa
1 4 0 pat
1 33 1 pa
1 2 2 pa
1 44 0 pa
0 40 0 pah
0 7 1 pah
0 16 0 pah
0 4 4 pac
0 3 3 pac
0 9 1 pc

0 15 0 ph
0 8 2 ph
1 10 0 pat
1 15 0 pa
1 200 10 pa
1 18 18 pa
1 7 0 pa
0 60 0 pc
0 22 0 pc
0 50 0 p
0 6 0 p
0 14 14 p
0 3 0 p

0 6 0 pc
0 4 4 p
1 8 0 pat
1 30 0 pa
0 1 1 pah
0 2 2 pah
1 28 3 pa
0 120 0 ph
0 35 2 ph
0 9 0 pt

0 1 1 c
0 1 1 c
0 2 2 c
1 8 0 t
1 70 2 -
1 45 0 -
1 3 0 -
1 66 5 -
0 12 0 h
1 38 0 -
0 9 1 c

0 2 2 -
0 1 1 -
0 2 2 -
0 1 1 -
1 7 0 t
1 52 0 -
1 24 1 -
1 90 4 -
1 5 0 t
1 31 0 -
0 3 3 -
0 4 4 -
0 3 3 -
0 6 2 -

0 4 4 -
0 3 3 -
1 6 0 t
1 120 3 -
1 2 0 -
1 75 0 -
0 20 0 h
0 31 0 h
0 55 0 h
0 5 5 -
0 4 4 -

0 8 0 c
0 14 0 h
1 11 0 t
1 40 0 -
1 22 0 -
1 18 2 -
1 64 0 -
0 16 16 -
0 12 11 -
0 10 9 -
0 7 0 c

1 30 0 -
1 12 0 -
1 1 0 -
1 50 1 -

1 15 0 -

1 6 0 t
1 9 0 -
1 14 0 -
0 5 0 c
0 45 0 c
0 28 0 h

1 2 0 pa

1 1 0 pa

1 4 0 pa
1 3 0 pa

1 2 1 pa

0 2 2 pc
1 3 0 pat
1 2 1 pa

0 30 0 pc
0 20 0 ph
1 2 0 pa
1 9 9 pa
1 1 0 pa
0 30 0 ph
0 30 0 p

1 5 0 pat
1 400 0 pa
1 12 6 pa
1 3 3 pa
1 1 0 pa

0 10 0 ph
1 10 0 pat
1 10 0 pa
1 10 2 pa
1 10 0 pa
0 10 0 pc
0 10 0 p

0 80 0 pah
1 7 0 pa
0 90 3 pah
1 4 4 pa
0 70 0 pac
1 150 0 pa
0 2 0 pah
0 1 0 pac

0 6 6 p
0 40 0 p
1 60 2 pa
0 60 2 p

1 11 0 -

1 4 0 -

1 25 0 -
1 2 0 -

0 2 2 -
0 3 3 -

0 12 0 ch
0 5 0 c

0 8 0 ph
0 3 3 pc

1 5 0 pat
1 60 0 pa
1 60 0 pa
1 60 0 pa

0 1 1 pc
0 2 2 pc
1 9 0 pat
1 45 0 pa
1 120 3 pa
1 33 0 pa

0 8 0 pc
0 11 0 ph
1 7 0 pat
1 20 0 pa
1 9 0 pa
1 85 2 pa
1 14 0 pa

0 3 3 pc
1 12 0 pat
1 150 0 pa
1 28 4 pa
1 10 0 pa

1 30 0 pa
1 90 1 pa
1 7 0 pa

0 2 2 pc
1 6 0 pat
1 70 0 pa
1 55 0 pa
0 30 0 pah
0 42 0 pah

1 8 0 pat
1 64 2 pa
1 38 0 pa
0 26 0 pac

1 5 0 pat
1 40 0 pa
1 52 0 pa
0 30 0 p

1 7 0 t
1 44 0 -
1 61 2 -
1 27 0 -

0 2 2 -
0 3 3 -
1 6 0 t
1 35 0 -
1 80 1 -
1 58 0 -
"""
