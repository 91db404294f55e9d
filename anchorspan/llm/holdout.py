"""Hand-written and hand-checked texts with their kind, on which the probabilities of the text kinds are calibrated."""

from __future__ import annotations

PROSE = [
    "We moved the peak calls to the new assembly on Monday. Two of them were lost, and nobody could say why until the gap in the chain was found.",
    "The first thing to check is the name of the chromosome. If one file says chr1 and the other says 1, nothing will match, and the report will be empty.",
    "I have read your mail twice. The short answer is that the tool does not trim the record; it drops it. The long answer is in the manual, on the page about blocks.",
    "> Could you tell me which of the files is the older one?\n> I think that the second one has the wrong header.\n\nYes, the second one is older. Please use the first, and delete the other when you are done with it.",
    "it took the whole night to load the data and in the morning we saw that half of the rows were not there so we had to start again from the backup and wait until noon",
    "THE TABLE WAS WRITTEN TWICE BECAUSE THE SCRIPT WAS STARTED BY TWO USERS AT THE SAME TIME. WE KEPT THE LATER COPY AND REMOVED THE FORMER ONE.",
    "[10:15] I am still waiting for the results of the second run, and I do not think that they will be here before the meeting.\n[10:18] That is fine, we can look at them on Friday with the others.",
    "- The strand of the gene was turned around in the new map, so the alleles had to be changed as well.\n- We asked the other group about it, but they have not answered yet, and it may take some time.",
    "Die Kette deckt den ganzen Arm ab, aber nicht die Mitte. Wir haben deshalb die Zeilen von Hand geprüft und die falschen entfernt.",
    "Le fichier que vous avez envoyé n'est pas complet. Il manque la fin de la dernière ligne, et nous ne pouvons pas le lire avec cet outil.",
    "El programa no encontró la cadena, porque el nombre del archivo no era el mismo. Lo cambiamos y la segunda vez todo fue bien.",
    "The values that we see here were taken from the\nlast release, and they are not the same as those\nof the one before. It is not a big change, but it\nshould be said in the text of the paper.",
    "Q: What happens when a point lies in a gap of the chain?\nA: It is written to the file of the rejected records, with a word on why it could not be placed.",
    "# Summary\n\nAll but three of the records were placed. The three that were not are close to the end of the short arm, where the old map and the new one do not agree at all.",
    "The header says that there are nine columns. There are ten in most of the rows.\n- check the header\n- send the file again\nAfter that we can go on with the comparison, and I will write to the others that it was only a matter of one column too many.",
    "Il est clair que la carte a changé, mais nous ne savons pas encore où. Le groupe a promis une réponse pour la semaine prochaine.",
    "Please have a look at the second figure, in which the mean depth is shown for each arm. It is much lower than we had thought, and I would like to know if the filter was on.",
    "Nobody was able to say whether this was a fault of the chain or of the reader. In the end we wrote our own small script, and it gave the right answer at once.",
]
LIST = [
    "- apples\n- pears\n- plums\n- cherries\n- quinces",
    "1. load the chain\n2. read the records\n3. place them\n4. write the rest\n5. count both",
    "BRCA1\nTP53\nEGFR\nKRAS\nMYC\nPTEN\nRB1\nALK",
    "* chr1:1000-2000\n* chr2:500-900\n* chr7:10-75\n* chrX:8000-8100\n* chr9:77-92",
    "a) lost in the gap\nb) kept as it was\nc) split in two\nd) on the other strand\ne) not known",
    "[x] mail the lab\n[ ] rerun step two\n[x] clean the disk\n[ ] book a room\n[ ] print the map",
    "the short arm\nthe long arm\nthe centre\nboth ends\nthe first exon\nthe last exon",
    "-> reads.bam\n-> peaks.bed\n-> calls.vcf\n-> depth.wig\n-> genes.gff",
    "• Basel\n• Genf\n• Bern\n• Chur\n• Zug\n• Thun",
    "sample one: done\nsample two: open\nsample three: done\nsample four: lost\nsample five: open\nsample six: done",
    "These are the files that were sent:\n- run_1.bed\n- run_2.bed\n- run_3.bed\n- run_4.bed\n- run_5.bed\n- run_6.bed\n- run_7.bed\n- run_8.bed",
    "(1) the old map;\n(2) the new map;\n(3) the chain between;\n(4) the list of names;\n(5) the sizes",
]
TABLE = [
    "name,size,share\nchr1,248,8.1\nchr2,242,7.9\nchr3,198,6.4\nchr4,190,6.2",
    "| file | rows | lost |\n|---|---|---|\n| a.bed | 100 | 2 |\n| b.bed | 250 | 0 |\n| c.bed | 80 | 1 |",
    "id\tstart\tend\nr1\t10\t25\nr2\t40\t90\nr3\t95\t99",
    "place     rows    share\nBern      12      3.5%\nBasel     340     41.0%\nGenf      7       0.9%",
    "gene;chrom;strand;reads\nTP53;17;-;410\nMYC;8;+;230\nALK;2;-;77\nRB1;13;+;19",
    "10:12|ok|33\n10:13|ok|35\n10:14|bad|0\n10:15|ok|31",
    "sample    depth    ratio    state\nS1        30       0.91     kept\nS2        12       0.40     lost\nS3        28       0.88     kept\nS4        31       0.93     kept",
    "The counts of the last run are given here.\nchrom,seen,placed,lost,share\n1,200,198,2,99.0\n2,180,171,9,95.0\n3,150,150,0,100.0\n4,142,140,2,98.6\n5,139,121,18,87.1\n6,120,119,1,99.2",
    "NA,3,17,fx\n5,,22,tq\n6,1,NA,br\n9,4,28,ov",
    "| 1 | 2 | 3 |\n| 4 | 5 | 6 |\n| 7 | 8 | 9 |\n| 0 | 0 | 0 |",
]
JUNK = [
    "00000000: 7f45 4c46 0201 0100 0000 0000 0000 0000\n00000010: 0300 3e00 0100 0000 a010 0000 0000 0000\n00000020: 4000 0000 0000 0000 9839 0000 0000 0000",
    ">seq1\nACGTTGCATGCCGATAGCTAGGCTTACGATCGGATCCTAGGCTAAACGT\nGGCTAGCTAGGATCGATTACGGCTTAGCTAGGCATCGGATTACGCTAGGA",
    "TWFuIGlzIGRpc3Rpbmd1aXNoZWQsIG5vdCBvbmx5IGJ5IGhpcyByZWFzb24\nsIGJ1dCBieSB0aGlzIHNpbmd1bGFyIHBhc3Npb24gZnJvbSBvdGhlciBhbm\nltYWxzLCB3aGljaCBpcyBhIGx1c3Qgb2YgdGhlIG1pbmQ=",
    "xq!zv kl;pw rtb|0n vbx!!s qw:zk |ptr mzx;k qlw0!v zzk|rt bvn!x kp;wq tr|zx",
    "----------\n==========\n**********\n~~~~~~~~~~\n##########",
    "<div class='a'>&nbsp;</div><br/>\n<span id='x'>&nbsp;</span><br/>\n<td>&nbsp;</td><br/>{{foot}}",
    "Ã©Ã¨ â€™Ã¼ ï¿½ï¿½ Ã¤Ã¶ â€œÃ© ï¿½Ã± Ã©Ã© â€™â€™ Ã¼Ã¤ ï¿½Ã¶",
    "chain chain chain chain chain chain chain chain chain chain chain chain chain chain chain chain chain chain",
    "see below see below see below see below see below see below see below see below see below see below",
    "NA NA NA NA NA NA NA NA NA NA NA NA NA NA NA NA NA NA NA NA NA NA NA NA",
    "The dump of the last block follows.\n00000000: 9c41 88f0 1b3e 77aa 0c0d 91e2 aa10 ffee\n00000010: 1f00 cd21 b409 4ccd 2154 6869 7320 7072\n00000020: 6f67 7261 6d20 6361 6e6e 6f74 2062 6520",
    "_._._._._._._._._._._\n%%%%%%%%%%%%%%%%%%%%\n/\\/\\/\\/\\/\\/\\/\\/\\/\\/\\/\\",
]
HOLDOUT = [(text, kind) for kind, texts in (("prose", PROSE), ("list", LIST), ("table", TABLE), ("junk", JUNK)) for text in texts]
