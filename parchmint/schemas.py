"""Row types. Boxes are pixels with y down for recognised text and points with y up for PDF items."""

from __future__ import annotations

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
POINT = "struct<x:double,y:double>"
CORNERS = f"array<{POINT}>"
SETTINGS = "struct<filter:string,brightness:double,contrast:double,whiten:double,sharpen:double,removeShadow:double>"
WORD = f"struct<text:string,confidence:double,bbox:{BOX},baseline:{BOX}>"
PROCESSED_WORD = f"struct<text:string,confidence:double,bbox:{BOX},baseline:{BOX},removed:boolean,flagged:boolean,reason:string>"
RUN = f"struct<text:string,confidence:double,flagged:boolean,bbox:{BOX}>"
OCR_LINE = f"struct<text:string,confidence:double,bbox:{BOX},words:array<{WORD}>>"
PDF_ITEM = "struct<str:string,transform:array<double>,width:double,height:double,fontName:string,hasEOL:boolean>"
TEXT_ITEM = "struct<text:string,x:double,y:double,width:double,height:double,fontName:string,hasEol:boolean>"
TOKEN = f"struct<text:string,bbox:{BOX},page:int,fontSize:double,fontName:string,bold:boolean,italic:boolean,confidence:double,source:string>"
LINE = f"struct<tokens:array<{TOKEN}>,text:string,bbox:{BOX},fontSize:double>"
BLOCK = f"struct<kind:string,bbox:{BOX},text:string,lines:array<{LINE}>,rows:array<array<string>>,altText:string,level:int>"
IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
